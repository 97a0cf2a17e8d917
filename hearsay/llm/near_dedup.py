"""Near-duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles.  Under every one of ``SKETCHES`` random
orders its ``KEPT`` least shingles, told apart by occurrence, are kept in text order: the
order MinHash.  Texts that agree in one of these meet in a bucket.  A pair is linked when
the edit similarity of the shingle sequences, ``1 - distance / longer length``, is
``SIMILARITY`` or more, found by an alignment in a band that widens until it decides.

Exact copies (the same words) are joined first and go on as one.  A bucket's texts are first
paired with its hub, the text that shares most buckets with others.  In buckets that then
still hold several classes, all pairs of texts in different classes are looked at: in cells of
two blocks of about ``BLOCK`` texts, spread over tasks, pairs go that have too few shingles
in common to be similar, which their outlines tell without error; the others are aligned there, but
for those whose classes other links of the cell have joined by then.  So pairs stay in their cell, which gives out fewer
links than it has texts.  Classes are the connected components of the links: those of all similar pairs that meet in a bucket.

Texts without words (null, empty) and rows with a null key are in no class but their own.
Texts of one to four words have one shingle.  Repeated rows are exact copies.  Rows that share
a key but not a text are classed each by its own text; classes are linked by similarity only,
so two of them can bear one least key.  Other columns are left out (``dedup`` keeps all
columns of the rows that stay).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.components import components
from hearsay.llm.packed import Hasher, chunks, flat, shingles, words
from hearsay.llm.tables import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
KEPT = 3
BLOCK = 256
LONG = 2_048  # shingles; the outline of a longer text has counts
_random = np.random.default_rng(6)
_FACTORS = _random.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_AGAIN = np.uint64(0x9FB21C651E98DF25)


# --- sketches ----------------------------------------------------------------------


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of the occurrence mixed in."""
    order = np.argsort(hashes, kind="stable")
    line = hashes[order]
    same = line[1:] == line[:-1]
    if not same.any():
        return hashes
    begins = np.concatenate(([True], ~same))
    first = np.maximum.accumulate(np.where(begins, np.arange(len(line)), 0))
    occurrence = np.empty(len(line), dtype=np.uint64)
    occurrence[order] = (np.arange(len(line)) - first).astype(np.uint64)
    return hashes ^ (occurrence * _AGAIN)


def order_minhash(hashes: np.ndarray) -> np.ndarray:
    """One number per random order: its least shingles, in text order."""
    keys = labelled(hashes)
    out = np.empty(SKETCHES, dtype=np.int64)
    step = max(1, 1_000_000 // max(len(keys), 1))
    for a in range(0, SKETCHES, step):
        ranked = keys[None, :] * _FACTORS[a:a + step, None] + _SHIFTS[a:a + step, None]
        ranked ^= ranked >> np.uint64(29)
        ranked *= np.uint64(0xBF58476D1CE4E5B9)
        if len(keys) > KEPT:
            least = np.sort(np.argpartition(ranked, KEPT - 1, axis=1)[:, :KEPT], axis=1)
        else:
            least = np.repeat(np.arange(len(keys))[None], len(ranked), 0)
        for i, places in enumerate(least):
            total = a + i + 1
            for h in keys[places].tolist():
                total = (total * 0x9E3779B97F4A7C15 + h) & ((1 << 64) - 1)
            out[a + i] = total - (1 << 63)
    return out


def sketched(docs: DataFrame, key: str) -> DataFrame:
    """``key, mark, digest, body, sketch`` of every row with a key and words; the body is packed, the mark is the text's MD5."""
    taken = docs.select(F.col(key).alias("key"), "text", F.md5("text").alias("mark")).filter(F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = flat(batch.column(1))
            for first, last, part, ends in chunks(data, limits):
                starts, stops, owner = words(part, ends)
                found, of = shingles(Hasher(part).ranges(starts, stops), owner, SHINGLE_WORDS)
                cuts = np.searchsorted(of, np.arange(last - first + 1))
                rows = [i for i in range(last - first) if cuts[i] < cuts[i + 1]]
                texts = [b" ".join(part[ends[i]:ends[i + 1]].tobytes().split()) for i in rows]
                places = pa.array([first + i for i in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(places), batch.column(2).take(places),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                    pa.array([zlib.compress(t, 1) for t in texts], pa.binary()),
                    pa.array([order_minhash(found[cuts[i]:cuts[i + 1]]).tolist() for i in rows], pa.list_(pa.int64())),
                ], names=["key", "mark", "digest", "body", "sketch"])

    return taken.mapInArrow(run, f"key {dict(taken.dtypes)['key']}, mark string, digest binary, body binary, sketch array<bigint>")


# --- alignment -----------------------------------------------------------------------


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[:len(a) - tail], b[:len(b) - tail]


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


def band_distances(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances by alignments that stay ``width`` or less off the diagonal, all pairs abreast.

    Distances up to ``width`` are exact and greater ones upper bounds; pairs whose
    lengths differ by more than ``width`` get infinity.
    """
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, across = int(n.max()), 2 * width + 1
    far = 1 << 30
    left = np.zeros((len(pairs), rows), dtype=np.uint64)
    right = np.zeros((len(pairs), rows + across + 1), dtype=np.uint64)  # column width + j holds b[j]
    known = np.zeros(right.shape, dtype=bool)
    for k, (a, b) in enumerate(pairs):
        left[k, :len(a)] = a
        size = min(len(b), right.shape[1] - width)
        right[k, width:width + size] = b[:size]
        known[k, width:width + size] = True
    off = np.arange(across) - width
    line = np.where(off >= 0, off, far)[None].repeat(len(pairs), 0).astype(np.int64)
    line[off[None, :] > m[:, None]] = far
    out = np.full(len(pairs), far, dtype=np.int64)
    place = np.arange(across)

    def done(i: int) -> None:
        ended = np.flatnonzero(n == i)
        at = m[ended] - i + width
        inside = (at >= 0) & (at < across)
        out[ended[inside]] = line[ended[inside], at[inside]]

    done(0)
    for i in range(1, rows + 1):
        # Cell d of row i stands at column j = i + d - width, with b[j - 1] beside it.
        other = right[:, i - 1:i - 1 + across]
        cost = (other != left[:, i - 1:i]) | ~known[:, i - 1:i - 1 + across]
        new = line + cost
        new[:, :-1] = np.minimum(new[:, :-1], line[:, 1:] + 1)
        if i <= width:  # column 0: everything so far is deleted
            new[:, width - i] = i
            new[:, :width - i] = far
        new = np.minimum.accumulate(new - place, axis=1) + place
        if i < width:
            new[:, :width - i] = far
        line = np.minimum(new, far)
        done(i)
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """Whether the edit similarity of the sequences is ``least`` or more, for every pair."""
    answer = np.zeros(len(pairs), dtype=bool)
    waiting = []
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int(np.floor((1 - least) * longer + 1e-9))
        if abs(len(a) - len(b)) > most:
            continue
        x, y = _trim(a, b)
        if max(len(x), len(y)) <= most:
            answer[k] = True
        elif max(len(x), len(y)) - _in_common(x, y) <= most:
            waiting.append((k, x, y, most))
    width = 8
    while waiting:
        waiting.sort(key=lambda w: len(w[1]))
        later, i = [], 0
        while i < len(waiting):
            j, size = i, 0
            while j < len(waiting) and (j == i or (j - i + 1) * (len(waiting[j][1]) + 2 * width) <= 200_000):
                j += 1
            group = waiting[i:j]
            found = band_distances([(x, y) for _, x, y, _ in group], width)
            for (k, x, y, most), distance in zip(group, found.tolist()):
                if distance <= most:
                    answer[k] = True
                elif width < most:
                    later.append((k, x, y, most))
            i = j
        waiting, width = later, width * 4
    return answer


def sequence(body: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
    limits = np.array([0, len(data)])
    starts, stops, owner = words(data, limits)
    return shingles(Hasher(data).ranges(starts, stops), owner, SHINGLE_WORDS)[0]


def verified(bodies: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs ``(u, v)`` whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                known = {}
                both = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    for body in (x, y):
                        if body not in known:
                            known[body] = sequence(body)
                    both.append((known[x], known[y]))
                yield part.select(["u", "v"]).filter(pa.array(similar(both, least)))

    kind = dict(bodies.dtypes)["key"]
    left = bodies.select(F.col("key").alias("u"), F.col("body").alias("left"))
    right = bodies.select(F.col("key").alias("v"), F.col("body").alias("right"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return joined.mapInArrow(run, f"u {kind}, v {kind}")


# --- pairs in large buckets --------------------------------------------------------------


def outline(hashes: np.ndarray) -> bytes:
    """Of up to ``LONG`` shingles a number of 16 bits each, in order; of more, counts of 4,096 sorts up to 255."""
    keys = labelled(hashes)
    if len(keys) <= LONG:
        return np.sort(keys >> np.uint64(48)).astype(np.uint16).tobytes()
    return np.minimum(np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=4096), 255).astype(np.uint8).tobytes()


def _most_in_common(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the sizes of the common multisets of short texts, by their outlines."""
    listed = np.intersect1d(np.concatenate(own), np.concatenate(others))
    total = np.zeros((len(own), len(others)), dtype=np.float32)
    for a in range(0, len(listed), 8192):
        columns = listed[a:a + 8192]
        sides = []
        for texts in (own, others):
            values = np.concatenate(texts)
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            hit = columns[at] == values
            counts = np.zeros((len(texts), len(columns)), dtype=np.float32)
            np.add.at(counts, (owner[hit], at[hit]), 1)
            sides.append(counts)
        total += sides[0] @ sides[1].T  # a product of counts is no less than the lesser count
    return total


def _counted(outlined: bytes, length: int) -> np.ndarray:
    if length > LONG:
        return np.frombuffer(outlined, dtype=np.uint8).astype(np.int32)
    return np.minimum(np.bincount(np.frombuffer(outlined, dtype=np.uint16) >> 4, minlength=4096), 255).astype(np.int32)


def possible(owns: tuple, others: tuple, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different classes that may be similar, of two lists of texts.

    A list has classes, lengths and outlines.  Pairs of ``least`` similarity are all among them.
    """
    longer = np.maximum(owns[1][:, None], others[1][None])
    most = np.floor((1 - least) * longer + 1e-9)
    open_ = (owns[0][:, None] != others[0][None]) & (np.abs(owns[1][:, None] - others[1][None]) <= most)
    short = [np.flatnonzero((t[1] <= LONG) & open_.any(axis)) for t, axis in ((owns, 1), (others, 0))]
    if len(short[0]) and len(short[1]):
        lists = [[np.frombuffer(t[2][i], dtype=np.uint16) for i in places] for t, places in zip((owns, others), short)]
        at = np.ix_(*short)
        open_[at] &= longer[at] - _most_in_common(*lists) <= most[at]
    i, j = np.nonzero(open_)
    stays = np.ones(len(i), dtype=bool)
    known = {}
    for k in np.flatnonzero((owns[1][i] > LONG) | (others[1][j] > LONG)).tolist():
        both = []
        for side, (t, place) in enumerate(((owns, i[k]), (others, j[k]))):
            if (side, place) not in known:
                known[side, place] = _counted(t[2][place], t[1][place])
            both.append(known[side, place])
        apart = int(np.abs(both[0] - both[1]).sum())
        stays[k] = longer[i[k], j[k]] - (owns[1][i[k]] + others[1][j[k]] - apart) / 2 <= most[i[k], j[k]]
    return i[stays], j[stays]


def _outlines(bodies: DataFrame) -> DataFrame:
    """``key, length, outline, body`` of ``bodies(key, body)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sequence(body) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                pa.array([outline(s) for s in found], pa.binary()), batch.column(1)], names=["key", "length", "outline", "body"])

    return bodies.select("key", "body").mapInArrow(run, f"key {dict(bodies.dtypes)['key']}, length bigint, outline binary, body binary")


def joining(i: np.ndarray, j: np.ndarray, owns: list, bodies: list[bytes], least: float, step: int = 200) -> list[int]:
    """Of the pairs of places ``(i, j)`` similar ones that join all classes ``owns`` which any similar pair joins.

    A pair of texts whose classes are joined already adds nothing and is not aligned, so there
    are fewer links than classes.
    """
    names = {own: k for k, own in enumerate(dict.fromkeys(owns))}
    label = np.array([names[own] for own in owns], dtype=np.int64)  # of the class a text is in by now
    known: dict[int, np.ndarray] = {}
    links, waiting = [], np.arange(len(i))
    while len(waiting):
        waiting = waiting[label[i[waiting]] != label[j[waiting]]]
        # One pair of every two classes first: the others of these often need no alignment then.
        both = np.sort(np.stack([label[i[waiting]], label[j[waiting]]]), axis=0)
        first = np.unique(both[0] * (len(names) + 1) + both[1], return_index=True)[1][:step]
        taken = waiting[first]
        for place in np.unique(np.concatenate([i[taken], j[taken]])).tolist():
            if place not in known:
                known[place] = sequence(bodies[place])
        alike = similar([(known[a], known[b]) for a, b in zip(i[taken].tolist(), j[taken].tolist())], least)
        for k in taken[alike].tolist():
            a, b = label[i[k]], label[j[k]]
            if a != b:
                label[label == b] = a
                links.append(k)
        waiting = np.delete(waiting, first)
        if len(known) > 4 * step:
            known.clear()
    return links


def _cell_links(members: DataFrame, outlines: DataFrame, least: float) -> DataFrame:
    """Similar pairs ``(u, v)`` of ``members(bucket, key, own, n)`` that meet in a bucket, enough to join their classes.

    A bucket of ``n`` texts is dealt into blocks; two blocks, or one by itself, are a cell.  Pairs are verified where
    they meet: no more links leave a cell than it has texts.
    """
    kind = dict(members.dtypes)["key"]
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).join(outlines, "key")
    cells = dealt.select("bucket", "block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"),
                         "key", "own", "length", "outline", "body")
    cells = cells.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "key", "own", "length", "outline", "body")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        block, keys, owns, lengths = (table.column(c).to_numpy() for c in ("block", "key", "own", "length"))
        outlined = table.column("outline").to_pylist()
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sides = [np.flatnonzero(block == b) for b in (low, high)]
        lists = [(owns[s], lengths[s], [outlined[k] for k in s]) for s in sides]
        i, j = possible(*lists, least) if len(sides[0]) and len(sides[1]) else (np.zeros(0, int), np.zeros(0, int))
        i, j = sides[0][i], sides[1][j]
        stays = keys[i] > keys[j] if low == high else keys[i] != keys[j]
        i, j = i[stays], j[stays]
        if len(i):
            found = np.array(joining(i, j, owns.tolist(), table.column("body").to_pylist(), least), dtype=np.int64)
            i, j = i[found], j[found]
        a, b = keys[i], keys[j]
        u, v = np.maximum(a, b), np.minimum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u, table.schema.field("key").type), pa.array(v, table.schema.field("key").type)],
                                          names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in range(3)]
            changes = np.zeros(max(len(batch) - 1, 0), dtype=bool)
            for column in names:
                changes |= column[1:] != column[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                named = tuple(column[a] for column in names)
                if named != cell and held:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                cell = named
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(pa.Table.from_batches(held))

    placed = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.mapInArrow(run, f"u {kind}, v {kind}").distinct()


# --- classes -------------------------------------------------------------------------


def _bodies(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, body`` of the texts in ``pairs``: the bodies of all rows are shuffled once for it."""
    needed = pairs.select(F.col("u").alias("n")).union(pairs.select("v")).distinct()
    # The same plan at every size: whether few keys could be broadcast is not left to chance.
    return written(rows.select("n", "body").hint("merge").join(needed, "n").select(F.col("n").alias("key"), "body"), "bodies")


def _hubs(members: DataFrame) -> DataFrame:
    """Every bucket's hub: its text of the greatest weight, then least key."""
    order = F.struct("weight", (-F.col("key")).alias("key"))
    return members.groupBy("bucket").agg(F.max(order).alias("top")).select("bucket", (-F.col("top.key")).alias("hub"))


def _open(members: DataFrame, merged: DataFrame) -> DataFrame:
    """``bucket, key, own, n`` of the buckets that hold several classes; ``own`` is the text's class."""
    named = written(members.join(merged.withColumnRenamed("node", "key"), "key", "left").select(
        "bucket", "key", F.coalesce("component", "key").alias("own")), "named")
    several = named.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n"))
    return written(named.join(several.filter("low < high").select("bucket", "n"), "bucket"), "open")


def _classed(docs: DataFrame, key: str, least: float) -> DataFrame:
    """``key, mark, own, class_id, n_copies`` of every row with a key and words; ``own`` tells classes apart.

    A text's number is that of its first row, whatever the keys.
    """
    rows = written(sketched(docs, key).withColumn("n", F.monotonically_increasing_id()), "sketched")
    copies = rows.groupBy("digest").agg(F.min(F.struct("key", "n")).alias("first"), F.count("*").alias("n_copies"))
    of_row = written(rows.select("key", "mark", "digest", "n").join(copies, "digest").select(
        "key", "mark", F.col("first.key").alias("rep"), F.col("first.n").alias("node"), "n_copies",
        (F.col("n") == F.col("first.n")).alias("is_first")), "copies")
    # Only the first of all exact copies goes on.
    firsts = of_row.filter("is_first").select("node", "rep")
    spread = rows.select("n", "sketch").join(firsts.select(F.col("node").alias("n")), "n").select(
        F.col("n").alias("key"), F.posexplode("sketch").alias("at", "value")).select(
        "key", F.xxhash64("at", "value").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(spread.join(sizes, "bucket"), "buckets")
    weights = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    members = written(shared.select("bucket", "key").join(weights, "key"), "members")
    links = merged = None
    met = members.join(_hubs(members), "bucket").filter("key <> hub")
    pairs = met.groupBy(F.greatest("key", "hub").alias("u"), F.least("key", "hub").alias("v")).agg(F.lit(1).alias("one"))
    pairs = written(pairs.select("u", "v"), "pairs")
    if not pairs.isEmpty():
        links = written(verified(_bodies(rows, pairs), pairs, least), "links")
        merged = written(components(links), "components")
        several = _open(members, merged)
        if not several.isEmpty():
            needed = several.select(F.col("key").alias("u"), F.col("key").alias("v"))
            outlines = written(_outlines(_bodies(rows, needed)), "outlines")
            found = written(_cell_links(several, outlines, least), "links")
            if not found.isEmpty():
                links = links.unionByName(found)
                merged = written(components(links), "components")
    result = of_row.select("key", "mark", "node", "rep", "n_copies")
    if merged is None:
        return result.select("key", "mark", F.col("node").alias("own"), F.col("rep").alias("class_id"), "n_copies")
    named = merged.join(firsts, "node")
    lowest = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = written(named.select("node", "component").join(lowest, "component"), "named")
    return result.join(named, "node", "left").select(
        "key", "mark", F.coalesce("component", "node").alias("own"), F.coalesce("class_id", "rep").alias("class_id"), "n_copies")


def classes(docs: DataFrame, key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``key, class_id, n_copies`` for every row of ``docs(key, text)``; keys are whole numbers.

    ``class_id`` is the least key of the class, ``n_copies`` the number of exact copies of the text.
    """
    kind = dict(docs.dtypes)[key]
    result = _classed(docs, key, least)
    alone = docs.filter(F.col(key).isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return result.select(F.col("key").cast(kind).alias(key), F.col("class_id").cast(kind).alias("class_id"), "n_copies").unionByName(
        alone.select(F.col(key), F.col(key).alias("class_id"), F.lit(1).cast("bigint").alias("n_copies")))


def dedup(docs: DataFrame, key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: of every class the text of the least key, once.

    Of several texts with that key the one of the least MD5 stays.  Rows without words and
    with a null key all stay.
    """
    texts = written(_classed(docs, key, least).groupBy("own", "key", "mark").agg(F.count("*").alias("rows")), "texts")
    stay = texts.groupBy("own").agg(F.min(F.struct("key", "mark")).alias("first"), F.sum("rows").alias("all"))
    # Texts to drop, and of those that stay the ones that occur in several rows.
    counted = texts.join(stay.filter(F.col("all") > 1).select("own", "first"), "own").select(
        F.col("key").alias("k"), F.col("mark").alias("m"),
        ((F.col("key") != F.col("first.key")) | (F.col("mark") != F.col("first.mark"))).alias("drop"), "rows")
    counted = written(counted.filter("drop OR rows > 1"), "dropped")
    # Rows travel as one column: theirs may bear any name.
    marked = docs.select(F.col(key).alias("key"), F.md5("text").alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = marked.join(counted, (F.col("key") == F.col("k")) & (F.col("mark") == F.col("m")), "left")
    stays = marked.filter(F.col("k").isNull()).select("row")
    if not counted.filter("NOT drop").isEmpty():
        several = marked.filter(F.col("k").isNotNull() & ~F.col("drop")).dropDuplicates(["k", "m"])
        stays = stays.unionByName(several.select("row"))
    return stays.select("row.*")
