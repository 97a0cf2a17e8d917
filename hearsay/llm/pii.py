"""Personal data: fixed patterns, and a skip-chain conditional random field over their tokens.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  Tokens with a
digit or ``@`` are the nodes of a random field over the labels ``O`` and the four kinds.
Neighbouring nodes share a transition potential; tokens that occur again in the document
(same form without punctuation and case, or the name part of an address) share an
agreement potential with their next occurrence, however distant, and with the nearest
occurrences before and after that a pattern has labelled: evidence is one step away, however
often a form occurs.  Loopy message passing spreads the labels of the patterns' tokens,
which are fixed, to the others, until a document's messages change by less than
``SETTLED``.  Runs of tokens that come out with the same kind at ``SURE`` or more are
added as spans.

The field's weights are learned from the patterns' own labels on at most ``sample``
documents, chosen by a hash of key and text; equal rows are one.  Every text is read whole; null counts as empty.
Spans are code points, end exclusive.  Repeated rows are searched each; other columns are
left out (``redact`` keeps the ones it is told to carry).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
SURE = 0.9
SETTLED = 1e-4
DAMPING = 0.3
PATIENCE = 100  # rounds, after which messages are damped ever more so that circling ones come to rest

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's first digit only: later starts in the same run of digits end alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNAL = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
_PLAIN = re.compile(r"[\W_]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans, by kind and place."""
    if not text:
        return []
    found = list(_emails(text))
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _small_parts(m.group())]
        for m in _CARD.finditer(text):
            digits = _only_digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- the random field ------------------------------------------------------------

N_FEATURES = 24


def _features(token: str) -> list[int]:
    """Numbers of the features a token has; 0 is the constant."""
    digits = _only_digits(token)
    n = len(digits)
    out = [0, 1 + int(np.searchsorted([1, 3, 4, 5, 8, 11, 16, 20], n, side="right"))]
    tests = ("@" in token, token.startswith("+"), "(" in token, "-" in token, any(c.isalpha() for c in token),
             token.count(".") >= 3, 16 <= n <= 19 and luhn(digits), "/" in token or ":" in token,
             bool(_IP.search(token)) and _small_parts(_IP.search(token).group()))
    return out + [10 + k for k, yes in enumerate(tests) if yes]


class Field:
    """Nodes, edges and pattern labels of many documents at once."""

    def __init__(self):
        self.features: list[list[int]] = []
        self.labels: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.owner: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int, int]] = []
        self.known: list[tuple[int, int, int]] = []  # to the nearest labelled occurrences; not learned from

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        covered = sorted((s, e, KINDS.index(k) + 1) for k, s, e in base)
        # Spans of different kinds may overlap; the furthest end so far bounds the search back.
        starts = [c[0] for c in covered]
        reach = list(np.maximum.accumulate([c[1] for c in covered])) if covered else []
        before, seen = -2, {}
        for place, m in enumerate(_TOKEN.finditer(text)):
            token = m.group()
            if not _SIGNAL.search(token):
                continue
            node, label = len(self.labels), 0
            at = bisect_right(starts, m.end() - 1) - 1
            while at >= 0 and reach[at] > m.start():
                if covered[at][1] > m.start():
                    label = covered[at][2]
                    break
                at -= 1
            self.features.append(_features(token))
            self.labels.append(label)
            self.spans.append(m.span())
            self.owner.append(doc)
            if place == before + 1:
                self.chain.append((node - 1, node))
            before = place
            form = _PLAIN.sub("", token).lower()
            names = {form}
            if "@" in token:
                names.add(_PLAIN.sub("", token.split("@")[0]).lower())
            for name in names:
                if len(name) >= 3:
                    if name in seen:
                        self.skip.append((seen[name][-1], node, int(len(name) >= 6)))
                    seen.setdefault(name, []).append(node)
        for name, nodes in seen.items():
            for line in (nodes, nodes[::-1]):
                last = None
                for i, node in enumerate(line):
                    if self.labels[node]:
                        last = i
                    elif last is not None and last < i - 1:
                        self.known.append((line[last], node, int(len(name) >= 6)))

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.features), N_FEATURES))
        for i, own in enumerate(self.features):
            x[i, own] = 1
        return x


def learn(field: Field) -> dict:
    """Unary weights by multinomial regression, edge weights from counts of label pairs."""
    n = len(KINDS) + 1
    x, y = field.matrix(), np.array(field.labels, dtype=np.int64)
    weights = np.zeros((N_FEATURES, n))
    if len(y):
        target = np.eye(n)[y]
        for _ in range(400):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights += 2.0 * (x.T @ (target - p) / len(y) - 1e-4 * weights)
    pairs = np.ones((n, n)) * 0.5
    for a, b in field.chain:
        pairs[y[a], y[b]] += 1
    independent = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum()
    agreement = []
    for length in (0, 1):
        own = [(y[a], y[b]) for a, b, k in field.skip if k == length]
        same = sum(a == b for a, b in own)
        agreement.append(float(np.log((same + 4.0) / (len(own) - same + 1.0))))
    return {"unary": weights, "chain": np.log(pairs / independent) * 0.5, "skip": agreement}


def infer(field: Field, model: dict, rounds: int | None = None) -> np.ndarray:
    """Label probabilities of every node by damped loopy message passing: until every document is settled, or ``rounds``."""
    n = len(KINDS) + 1
    y = np.array(field.labels, dtype=np.int64)
    unary = field.matrix() @ model["unary"]
    fixed = y > 0
    unary[fixed] = np.where(np.eye(n)[y[fixed]] > 0, 0.0, -40.0)
    skip = field.skip + field.known
    edges = [(a, b) for a, b in field.chain] + [(a, b) for a, b, _ in skip]
    if edges:
        pairs = np.array(edges, dtype=np.int64)
        potential = np.concatenate([
            np.repeat(model["chain"][None], len(field.chain), 0),
            np.array([model["skip"][k] for _, _, k in skip])[:, None, None] * np.eye(n)[None]
            if skip else np.zeros((0, n, n))])
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        goal = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(source), n))
        _, doc = np.unique(np.array(field.owner)[source], return_inverse=True)
        active, damping = np.arange(len(source)), DAMPING
        for number in count():
            if not len(active) or number == rounds:
                break
            if number >= PATIENCE:
                damping = (1 + 9 * damping) / 10
            belief = unary.copy()
            np.add.at(belief, goal[active], messages[active])
            out = (belief[source[active]] - messages[back[active]])[:, :, None] + potential[active]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            step = (1 - damping) * (new - messages[active])
            messages[active] += step
            if rounds is None:  # documents are independent: settled ones leave
                change = np.zeros(doc.max() + 1)
                np.maximum.at(change, doc[active], np.abs(step).max(1))
                active = active[change[doc[active]] >= SETTLED]
        np.add.at(unary, goal, messages)
    p = np.exp(unary - unary.max(1, keepdims=True)) if len(unary) else unary
    return p / p.sum(1, keepdims=True) if len(p) else p


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    return start, end


def _plausible(kind: str, found: str) -> bool:
    digits = _only_digits(found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return _IP.fullmatch(found) is not None and _small_parts(found)
    return len(found) >= 5 if kind == "email" else 7 <= len(digits) <= 15


def added_spans(texts: dict[int, str], bases: dict[int, list[Span]], field: Field, model: dict) -> dict[int, list[Span]]:
    """Runs of neighbouring tokens with one sure label, apart from the patterns' spans."""
    out: dict[int, list[Span]] = {}
    if not field.labels:
        return out
    p = infer(field, model)
    label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    label[np.array(field.labels) > 0] = 0
    linked = set(field.chain)

    def long(node: int) -> bool:  # a whole number by itself, not a group of one
        start, end = field.spans[node]
        return len(_only_digits(texts[field.owner[node]][start:end])) >= 12

    i, n = 0, len(label)
    while i < n:
        j = i + 1
        if label[i]:
            while j < n and label[j] == label[i] and (j - 1, j) in linked and not (long(j - 1) and long(j)):
                j += 1
            doc = field.owner[i]
            start, end = _trimmed(texts[doc], field.spans[i][0], field.spans[j - 1][1])
            kind = KINDS[label[i] - 1]
            if _plausible(kind, texts[doc][start:end]) and not any(s < end and start < e for _, s, e in bases[doc]):
                out.setdefault(doc, []).append((kind, start, end))
        i = j
    return out


# --- tables ------------------------------------------------------------------------


def fit(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The field's weights, from at most ``sample`` documents with a digit or ``@``."""
    rank = F.xxhash64(F.lit("field"), F.coalesce(F.col(key).cast("string"), F.lit("")), "text")
    signal = docs.filter(F.col("text").rlike("[0-9@]")).select("text", rank.alias("rank"))
    ranks = signal.select("rank").distinct().orderBy("rank").limit(sample)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, n = Field(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                field.add(n, text, base_spans(text))
                n += 1
        counts = {"feature": [], "a": [], "b": [], "kind": []}
        for own, label in zip(field.features, field.labels):
            counts["feature"].append(",".join(map(str, own)))
            counts["a"].append(label)
            counts["b"].append(0)
            counts["kind"].append(0)
        for kind, edges in ((1, field.chain), (2, [(a, b) for a, b, k in field.skip if not k]),
                            (3, [(a, b) for a, b, k in field.skip if k])):
            for a, b in edges:
                counts["feature"].append("")
                counts["a"].append(field.labels[a])
                counts["b"].append(field.labels[b])
                counts["kind"].append(kind)
        yield pa.record_batch({"feature": pa.array(counts["feature"], pa.string()), "a": pa.array(counts["a"], pa.int32()),
                               "b": pa.array(counts["b"], pa.int32()), "kind": pa.array(counts["kind"], pa.int32())})

    # Equal rows meet by their rank, from the map side on.
    chosen = signal.join(F.broadcast(ranks), "rank").groupBy("rank").agg(F.min("text").alias("text")).select("text")
    # Sets of features and label pairs are few, whatever the sample.
    table = chosen.mapInArrow(gather, "feature string, a int, b int, kind int").groupBy("feature", "a", "b", "kind").agg(
        F.count("*").alias("n")).collect()
    return _from_counts(sorted(table))


def _from_counts(table) -> dict:
    """``learn`` on counted nodes and label pairs: at most 1,000 of each sort are weighed in."""
    field = Field()
    total = max(1, sum(r["n"] for r in table if r["kind"] == 0))
    scale = min(1.0, 50_000 / total)
    for r in table:
        if r["kind"] == 0:
            times = max(1, round(r["n"] * scale))
            field.features += [[int(v) for v in r["feature"].split(",")]] * times
            field.labels += [r["a"]] * times
    first = {}
    for i, label in enumerate(field.labels):
        first.setdefault(label, i)
    for r in table:
        if r["kind"] and r["a"] in first and r["b"] in first:
            edge, times = (first[r["a"]], first[r["b"]]), max(1, round(r["n"] * scale))
            if r["kind"] == 1:
                field.chain += [edge] * times
            else:
                field.skip += [(*edge, r["kind"] - 2)] * times
    return learn(field)


def search(texts: list[str | None], model: dict) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and added spans of every text."""
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    field, held, bases = Field(), {}, {}

    def flush():
        more = added_spans(held, bases, field, model)
        for i, base in bases.items():
            out[i] = (base, sorted(more.get(i, []), key=lambda s: (KINDS.index(s[0]), s[1])))

    for i, text in enumerate(texts):
        if text and _SIGNAL.search(text):
            held[i], bases[i] = text, base_spans(text)
            field.add(i, text, bases[i])
            if len(field.labels) > 20_000:
                flush()
                field, held, bases = Field(), {}, {}
    flush()
    return out


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    The four counts and the digest are of the patterns' spans, ``spans`` are all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = search(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *counts,
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([joined(_in_order(base + more)) for base, more in found], pa.string()),
                pa.array([len(more) for _, more in found], pa.int64())], names=names)

    names = [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return taken.mapInArrow(run, f"`{key}` {dict(taken.dtypes)[key]}, {counts}, base_sha256 string, spans string, n_added bigint")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """``*carry, text`` with all personal data replaced; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(*carry, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = search(texts, shared.value)
            clean = [redacted(t, base + more) if base or more else t for t, (base, more) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string())], names=batch.schema.names)

    return taken.mapInArrow(run, taken.schema)
