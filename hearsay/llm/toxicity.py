"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and digits
and signs to the letters they stand for, and joins the words with single blanks.  The
lexicon holds whole words and beginnings of words with their log-odds between toxic and
other labelled documents; exception phrases (two words that hold a term, but are seen in
documents that are not toxic) switch a match off.  A text's score is a logistic function
of its matched weights, normalised by its length.

Lexicon, phrases and function are fitted on at most ``sample`` labelled rows, chosen by a
hash of their key; every text is scored whole.  Null texts count as empty and get the
score of a text without matches; without labels of both kinds every score is 0.  Repeated
rows are scored each; other columns are left out.

A worker turns some ``SLICE_BYTES`` of texts at a time into strings and keeps no matches
of the texts before, so its memory does not follow the size of the batches it is given.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
MOST_TERMS = 2_000
MOST_PHRASES = 500
THRESHOLD = 0.3
PREFIXES = range(4, 10)
SLICE_BYTES = 1 << 20

# Letters that look alike, and signs that stand for letters.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏтквмнαοερνικτυ" "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
    "aeopcyxijsdhltkbmhaoepviktu" "abcdefghijklmnopqrstuvwxyz",
)
SIGNS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"),
         ("@", "a"), ("$", "s"), ("!", "i"))
_ODD = re.compile("[" + "".join(map(chr, LOOK_ALIKES)) + "\\u200b\\u200c\\u200d\\u00ad]")
_HIDDEN = re.compile("[\\u200b\\u200c\\u200d\\u00ad]")
_GAPS = re.compile(r"[\W_]+")
_SIGN_END = re.compile(r"(?<=\w)[!$]+(?=\s|$)")


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at either end."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = _HIDDEN.sub("", text).translate(LOOK_ALIKES)
    if "!" in text or "$" in text:
        text = _SIGN_END.sub(" ", text)
    for sign, letter in SIGNS:
        text = text.replace(sign, letter)
    return " " + _GAPS.sub(" ", text).strip() + " "


def patterns(folded: str) -> set[str]:
    """Candidate terms of a text: ``" word "`` and ``" beginning"``."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(" " + word[:n] for n in PREFIXES if n < len(word))
    return found


class Lexicon:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, terms: dict[str, float], phrases=()):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self._automaton.add_word(term, (len(term), weight, term))
        for phrase in phrases:
            text = f" {phrase} "
            self._automaton.add_word(text, (len(text), None, text))
        self._empty = not (terms or phrases)
        if not self._empty:
            self._automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[float, str]]:
        """The heaviest term at every start, without those inside an exception phrase."""
        if self._empty:
            return {}
        found: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight, term) in self._automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif start not in found or weight > found[start][0]:
                found[start] = (weight, term)
        for first, last in spared:
            for start in [s for s in found if first <= s < last]:
                del found[start]
        return found

    def features(self, folded: str, hits: dict | None = None) -> tuple[float, float, float]:
        hits = self.matches(folded) if hits is None else hits
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for w, _ in hits.values())
        kinds = {t: w for w, t in hits.values()}
        n_words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / max(n_words, 1)), math.log1p(sum(kinds.values()))


class Scorer:
    def __init__(self, model: dict):
        self._lexicon, self._weights = Lexicon(model["terms"], model["phrases"]), model["weights"]

    def score(self, text: str | None) -> tuple[float, dict[int, tuple[float, str]]]:
        """A text's score and matches."""
        folded = fold(text)
        hits = self._lexicon.matches(folded)
        if not self._weights:
            return 0.0, hits
        z = self._weights[0] + sum(w * x for w, x in zip(self._weights[1:], self._lexicon.features(folded, hits)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about ``SLICE_BYTES`` of texts (column ``text``) at a time, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for first, last in pairwise(cuts):
        if first < last:
            yield batch.slice(first, last - first)


def _judged(scorer: Scorer, batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    """``score, predicted, n_matches, terms`` instead of the last column, the text."""
    for part in _slices(batch, batch.num_columns - 1):
        scores, counts, terms = [], [], []
        for text in part.column(part.num_columns - 1).to_pylist():
            score, hits = scorer.score(text)
            scores.append(score)
            counts.append(len(hits))
            terms.append(json.dumps(sorted({t.strip() for _, t in hits.values()}), ensure_ascii=False))
        arrays = part.columns[:-1] + [
            pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
            pa.array(counts, pa.int64()), pa.array(terms, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "score", "predicted", "n_matches", "terms"])


def _log_odds(toxic, clean, n_toxic: int, n_clean: int):
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def _evidence(toxic, clean, n_toxic: int, n_clean: int):
    """G-squared of a term's two counts."""
    share = (toxic + clean) / (n_toxic + n_clean)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    return 2 * (part(toxic, n_toxic * share) + part(clean, n_clean * share)
                + part(n_toxic - toxic, n_toxic * (1 - share) + 1e-9)
                + part(n_clean - clean, n_clean * (1 - share) + 1e-9))


def _counted(sample: DataFrame, of_text, least: int) -> DataFrame:
    """``term, toxic, clean``: labelled documents that hold a term, for terms of ``least`` toxic or clean ones."""

    def packed(counts):
        terms = list(counts[0].keys() | counts[1].keys())
        columns = {"term": pa.array(terms, pa.string())}
        for name, label in (("toxic", 1), ("clean", 0)):
            columns[name] = pa.array([counts[label][t] for t in terms], pa.int64())
        return pa.record_batch(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in ((t, x) for part in _slices(batch, 0) for t, x in zip(*(c.to_pylist() for c in part.columns))):
                counts[label].update(of_text(text))
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield packed(counts)
                    counts = (Counter(), Counter())
        yield packed(counts)

    counted = sample.select("text", "label").mapInArrow(count, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(
        F.greatest("toxic", "clean") >= least)


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The model for ``docs(key, text)`` and ``labelled(key, label)``: terms, phrases and coefficients."""
    rank = F.crc32(F.concat(F.lit("sample"), F.col(key).cast("string")))
    chosen = labelled.filter("label IN (0, 1)").select(key, F.col("label").cast("int").alias("label"), rank.alias("rank"))
    chosen = chosen.orderBy("rank", key, "label").limit(sample)
    # At most ``sample`` narrow rows: a bound that does not grow with the tables.
    rows = docs.select(key, "text").join(F.broadcast(chosen), key).select("text", "label", (F.col("rank") % 3).alias("part"))
    rows = rows.persist()
    try:
        n = {(r["part"] == 0, r["label"]): r["n"] for r in rows.groupBy(F.col("part") == 0, "label").agg(
            F.first("part").alias("part"), F.count("*").alias("n")).collect()}
        n_toxic, n_clean = n.get((False, 1), 0), n.get((False, 0), 0)
        if not n_toxic or not n_clean:
            return {"terms": {}, "phrases": [], "weights": None}
        learning = rows.filter("part <> 0")
        terms = _terms(learning, n_toxic, n_clean)
        phrases = _phrases(learning, terms, n_toxic, n_clean)
        return {"terms": terms, "phrases": phrases, "weights": _calibrated(rows.filter("part = 0"), terms, phrases)}
    finally:
        rows.unpersist()


def _terms(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    def evidence(toxic, clean):
        seen, share = toxic + clean, (toxic + clean) / F.lit(float(n_toxic + n_clean))
        return F.when(toxic > seen * (n_toxic / (n_toxic + n_clean)), toxic * F.log(toxic / (share * n_toxic)))

    counted = _counted(rows, lambda text: patterns(fold(text)), least=3).filter("toxic >= 3")
    top = counted.orderBy(evidence(F.col("toxic"), F.col("clean")).desc_nulls_last(), "term").limit(5 * MOST_TERMS).collect()
    if not top:
        return {}
    toxic, clean = (np.array([r[c] for r in top], dtype=float) for c in ("toxic", "clean"))
    odds, strength = _log_odds(toxic, clean, n_toxic, n_clean), _evidence(toxic, clean, n_toxic, n_clean)
    tests = math.log(max(10, len(top)))
    kept = [(strength[i], top[i]["term"], odds[i]) for i in range(len(top)) if odds[i] > 1.0 and strength[i] > 10 + 2 * tests]
    kept.sort(reverse=True)
    return {term: float(weight) for _, term, weight in kept[:MOST_TERMS]}


def _phrases(rows: DataFrame, terms: dict[str, float], n_toxic: int, n_clean: int) -> list[str]:
    if not terms:
        return []
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def around(text):
        if "lexicon" not in _cache or _cache["terms"] is not shared.value:
            _cache.update(lexicon=Lexicon(shared.value), terms=shared.value)
        folded, found = fold(text), set()
        for start in _cache["lexicon"].matches(folded):
            end = folded.index(" ", start + 1)
            word = folded[start + 1:end]
            before, after = folded[:start].rsplit(" ", 1)[-1], folded[end + 1:end + 80].split(" ", 1)[0]
            found.update(f"{a} {b}" for a, b in ((before, word), (word, after)) if a and b)
        return found

    counted = _counted(rows, around, least=3).filter("clean >= 3").orderBy(F.col("clean").desc(), "term")
    return [r["term"] for r in counted.limit(MOST_PHRASES).collect()
            if _log_odds(r["toxic"], r["clean"], n_toxic, n_clean) < 0]


_cache: dict = {}


def _calibrated(rows: DataFrame, terms: dict[str, float], phrases: list[str]) -> list[float]:
    """Intercept and slopes of a logistic regression on the sample's remaining third."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, phrases))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            found = [lexicon.features(fold(t)) for part in _slices(batch, 0) for t in part.column(0).to_pylist()]
            columns = {f"x{k}": pa.array([f[k] for f in found], pa.float64()) for k in range(3)}
            yield pa.record_batch({**columns, "label": batch.column(1).cast(pa.int32())})

    # At most a third of the sample, four numbers a row.
    seen = rows.select("text", "label").mapInArrow(measure, "x0 double, x1 double, x2 double, label int").toPandas()
    x = np.column_stack([np.ones(len(seen)), seen[["x0", "x1", "x2"]].to_numpy(float)]) if len(seen) else np.zeros((0, 4))
    y = seen["label"].to_numpy(float) if len(seen) else np.zeros(0)
    beta = np.array([-2.0, 0.5, 0.5, 0.5])
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ (beta - np.array([-2.0, 0.5, 0.5, 0.5]))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


def score(docs: DataFrame, model: dict, key: str = "doc_id", threshold: float = THRESHOLD, carry=()) -> DataFrame:
    """``key, *carry, score, predicted, n_matches, terms`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(key, *carry, "text")
    kinds = dict(taken.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield from _judged(scorer, batch, threshold)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry))
    return taken.mapInArrow(run, f"{schema}, score double, predicted int, n_matches bigint, terms string")


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in _slices(batch, at):
                yield part.filter(pa.array([scorer.score(t)[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
