"""Removing repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.  Such
strings need not be compared with all others: each has an anchor, the least of the
``ANCHOR``-byte hashes in it, and equal strings have equal anchors at equal places.  A run
is a stretch of neighbouring strings with one anchor.  Runs whose anchor occurs once
repeat nowhere; runs that occur twice as a whole are repeated as a whole; the remaining
distinct runs of an anchor are dealt by what surrounds it: strings at about one distance
from the anchor all hold the same stretch around it, and only runs that agree in that can
share a string.  Groups of runs that agree, but not as a whole, go into one task, where a
suffix array over their texts, made by ``suffix_sort``, brings equal strings together, and
neighbours in it are compared byte by byte.  The stretch that all strings of a group share is
one symbol there, of its own for every group.

A group of more than ``MOST_RUNS`` is dealt again, by distances in narrower ranges
(``WIDTHS``); at a width of 1 the stretch is the string itself and groups are equal.

Texts are read as UTF-8 bytes, null as empty.  Repeated rows repeat each other's strings;
their runs are counted, but held and cut out once, however many copies there are.
Texts shorter than ``LENGTH`` lose nothing.  Other columns are left out (``cleaned`` returns
the remaining bytes as well).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import CHUNK_BYTES, Hasher, chunks, flat
from hearsay.llm.suffix_sort import suffix_array
from hearsay.llm.tables import as_text, written

LENGTH = 200
ANCHOR = 50
WIDTHS = (25, 5, 1)
MOST_RUNS = 2_048  # distinct runs of one group in one suffix array
ARRAY_BYTES = 48 << 10  # smaller groups share one
_PLACE = np.uint64((1 << 24) - 1)


# --- runs ------------------------------------------------------------------------------


def _parts(data: np.ndarray, limits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, limits, text numbers and first bytes of texts; long texts come in overlapping parts."""
    for first, last, part, ends in chunks(data, limits):
        if last - first > 1 or len(part) <= 2 * CHUNK_BYTES:
            yield part, ends, np.arange(first, last), np.zeros(last - first, np.int64)
            continue
        for at in range(0, len(part) - length + 1, CHUNK_BYTES):
            piece = part[at:at + CHUNK_BYTES + length - 1]
            yield piece, np.array([0, len(piece)]), np.array([first]), np.array([at])


def runs(data: np.ndarray, limits: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Anchor hash, text number, first byte, length, anchor's distance and hash of every run."""
    out = []
    for part, ends, texts, begin in _parts(data, limits, length):
        n = len(part)
        if n < length:
            continue
        hashes = Hasher(part)
        place = np.arange(n - anchor + 1)
        grams = hashes.ranges(place, place + anchor)
        least, reach, window = (grams & ~_PLACE) | place.astype(np.uint64), 1, length - anchor + 1
        while 2 * reach <= window:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < window:
            least = np.minimum(least[:len(least) - (window - reach)], least[window - reach:])
        within = place[:len(least)] + length <= np.repeat(ends[1:], np.diff(ends))[:len(least)]
        starts = np.flatnonzero(within)
        if not len(starts):
            continue
        at = (least[starts] & _PLACE).astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first, last = starts[begins], starts[np.append(begins[1:] - 1, len(starts) - 1)]
        own = np.searchsorted(ends, first, side="right") - 1
        at = at[begins]
        out.append((grams[at], texts[own], first - ends[own] + begin[own], last - first + length, at - first,
                    hashes.ranges(first, last + length)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*out))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, run, row, start, span`` of ``docs(row, text)``; the span holds length and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = flat(batch.column(1))
            anchor, text, start, size, distance, whole = runs(data, limits, length)
            rows = batch.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(whole), rows, pa.array(start.astype(np.int32)),
                 pa.array(((size << 8) | distance).astype(np.int32))], names=["anchor", "run", "row", "start", "span"])

    return docs.mapInArrow(run, "anchor bigint, run bigint, row bigint, start int, span int")


# --- suffix arrays -----------------------------------------------------------------------


def repeated_starts(texts: list[bytes], several: list[bool], length: int = LENGTH, shared: list | None = None) -> list[np.ndarray]:
    """For every text the starts of strings that also start elsewhere; ``several``: the text occurs again.

    ``shared``: names and places of stretches, one in each text, that all its strings hold.  Two texts with a string
    in common have stretches of one name, with the same bytes and as long, at the same place of that string: a stretch is
    sorted as one symbol.
    """
    sizes = np.array([len(t) for t in texts])
    if shared:
        names: dict = {}
        held = [(np.frombuffer(t[:a], np.uint8), names.setdefault((name, t[a:b]), len(names)), np.frombuffer(t[b:], np.uint8), b - a - 1)
                for t, (name, a, b) in zip(texts, shared)]
        lines = [np.concatenate((left + 1, [257 + symbol], right + 1)) for left, symbol, right, _ in
                 ((left.astype(np.int64), symbol, right.astype(np.int64), gone) for left, symbol, right, gone in held)]
        cut = np.array([gone for *_, gone in held])
    else:
        lines, cut = [np.frombuffer(t, np.uint8).astype(np.int64) + 1 for t in texts], np.zeros(len(texts), np.int64)
    limits = np.concatenate(([0], np.cumsum(sizes - cut + 1)))
    whole = np.zeros(limits[-1], dtype=np.int64)  # a 0 behind every text
    for line, at in zip(lines, limits):
        whole[at:at + len(line)] = line
    order = suffix_array(whole)
    own = np.repeat(np.arange(len(texts)), np.diff(limits))
    full = np.arange(len(whole)) - limits[own] + length <= sizes[own]
    order = order[full[order]]
    spans = length - cut  # of strings, in symbols
    found = np.zeros(len(whole), dtype=bool)
    if len(order) > 1:
        for span in np.unique(spans).tolist():
            windows = np.lib.stride_tricks.sliding_window_view(whole, span)
            met = np.flatnonzero((spans[own[order[:-1]]] == span) & (spans[own[order[1:]]] == span))
            for a in range(0, len(met), 20_000):
                left, right = order[met[a:a + 20_000]], order[met[a:a + 20_000] + 1]
                same = (windows[left] == windows[right]).all(1)
                found[left[same]] = True
                found[right[same]] = True
    return [np.arange(max(0, n - length + 1)) if again else np.flatnonzero(found[at:at + max(0, n - length + 1)])
            for at, n, again in zip(limits, sizes, several)]


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that strings at these ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _sorted_groups(table: DataFrame, width: int, length: int) -> DataFrame:
    """``row, first, last``: covered bytes, from ``table(bucket, row, start, several, text, distance)`` of ``_narrowed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ARRAY_BYTES and row[0] != bucket:
                    yield covered(held)
                    held, size = [], 0
                held.append(row)
                bucket, size = row[0], size + len(row[4]) - (length - width)
        if held:
            yield covered(held)

    def covered(held) -> pa.RecordBatch:
        # The bytes that all strings of a bucket share, see ``_narrowed``.
        shared = [(r[0], r[5] % width, r[5] % width + length - width + 1) for r in held]
        starts = repeated_starts([r[4] for r in held], [r[3] for r in held], length, shared)
        out = [(r[1], r[2] + a, r[2] + b) for r, s in zip(held, starts) if not r[3] for a, b in _ranges(s, length)]
        rows, first, last = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                                          names=["row", "first", "last"])

    parts = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return table.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "row bigint, first bigint, last bigint")


def _narrowed(table: DataFrame, width: int, length: int) -> DataFrame:
    """Runs cut into strings at most ``width`` apart, in buckets by the bytes that these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, row, start, several, text, distance in zip(*(c.to_pylist() for c in batch.columns)):
                last = len(text) - length  # strings start at 0 to last; the anchor is ``distance`` away
                low, high = distance - last, distance
                for k in range(low // width, high // width + 1):
                    near, far = max(low, k * width), min(high, (k + 1) * width - 1)
                    # All strings of this stretch of distances share these bytes around the anchor.
                    a, b = distance - k * width, distance - ((k + 1) * width - 1) + length
                    begin, end = distance - far, distance - near + length
                    name = hashlib.blake2b(text[a:b] + b"%d" % k, digest_size=8, key=bucket.to_bytes(8, "little", signed=True))
                    out.append((int.from_bytes(name.digest(), "little", signed=True), row, start + begin, several, text[begin:end],
                                distance - begin))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names) if out else \
                pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)

    kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()], table.columns
    return table.mapInArrow(run, table.schema)


def _packed(docs: DataFrame) -> DataFrame:
    """``docs(row, text)`` with deflated bodies, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = flat(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            bodies = [zlib.compress(raw[a:b], 1) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=names)

    names = [*docs.columns[:-1], "body"]
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns[:-1]) + ", body binary")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``bucket, row, start, several, text, distance`` of the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                body, out = zlib.decompress(batch.column(1)[i].as_py()), batch.column(2)[i].values
                starts, spans = (out.field(k).to_numpy() for k in (1, 2))
                texts = [body[s:s + (n >> 8)] for s, n in zip(starts.tolist(), spans.tolist())]
                yield pa.RecordBatch.from_arrays([
                    out.field(0), pa.array([batch.column(0)[i].as_py()] * len(texts), pa.int64()),
                    pa.array(starts.astype(np.int64)), out.field(3), pa.array(texts, pa.binary()),
                    pa.array((spans & 255).astype(np.int32))], names=["bucket", "row", "start", "several", "text", "distance"])

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "span", "several")).alias("runs"))
    bodies = _packed(docs).groupBy("row").agg(F.first("body").alias("body"))  # of all copies of a row one
    return bodies.join(lists, "row").select("row", "body", "runs").mapInArrow(
        run, "bucket bigint, row bigint, start bigint, several boolean, text binary, distance int")


# --- tables ----------------------------------------------------------------------------


def covered_bytes(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS, widths=WIDTHS) -> DataFrame:
    """``row, first, last``: byte ranges (end exclusive) to remove from ``docs(row, text)``."""
    # Copies of a row hold the same runs: each is kept once, with the number of its copies.
    found = _runs_of(docs, length).groupBy("anchor", "run", "row", "start", "span").agg(F.count("*").alias("copies"))
    anchors = found.groupBy("anchor").agg(
        F.sum("copies").alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).filter("n > 1").select(
        F.col("anchor").alias("a"), (F.col("low") != F.col("high")).alias("mixed"))
    matched = written(found.join(anchors, F.col("anchor") == F.col("a")).drop("a"), "matched")
    end = (F.col("start") + F.shiftright("span", 8)).cast("bigint")
    plain = matched.filter("NOT mixed").select("row", F.col("start").cast("bigint").alias("first"), end.alias("last"))
    distinct = written(matched.filter("mixed").groupBy("anchor", "run").agg(
        F.sum("copies").alias("n"), F.min(F.struct("row", "start", "span")).alias("rep")), "distinct")
    copies = distinct.filter("n > 1").select(F.col("anchor").alias("a"), F.col("run").alias("r"))
    whole = matched.filter("mixed").join(copies, (F.col("anchor") == F.col("a")) & (F.col("run") == F.col("r"))).select(
        "row", F.col("start").cast("bigint").alias("first"), end.alias("last"))
    wanted = distinct.select("anchor", "rep.*", (F.col("n") > 1).alias("several"))
    table, parts = _cut_out(docs, wanted), []
    for width in widths:
        table = written(_narrowed(table, width, length), "strings")
        sizes = table.groupBy("bucket").agg(
            F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"),
            F.max((~F.col("several")).cast("int")).alias("open")).filter("n > 1 AND open = 1").select(
            "bucket", (F.col("low") == F.col("high")).alias("equal"), (F.col("n") > most_runs).alias("large"))
        met = written(table.join(sizes, "bucket"), "met")
        parts.append(met.filter("equal").select(
            "row", F.col("start").alias("first"), (F.col("start") + F.octet_length("text")).cast("bigint").alias("last")))
        parts.append(written(_sorted_groups(met.filter("NOT equal AND NOT large").select(
            "bucket", "row", "start", "several", "text", "distance"), width, length), "ranges"))
        table = met.filter("NOT equal AND large").drop("equal", "large")
        if table.isEmpty():  # at the latest at a width of 1, where a bucket's strings are equal
            break
    result = plain.union(whole)
    for part in parts:
        result = result.union(part)
    return result


def _merged(ranges, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out if a < size]


def cleaned(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, with_bytes: bool = False, **options) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes) of every row."""
    kind = dict(docs.dtypes)[key]
    # Rows of one key and text are removed from alike, so this names a row well enough.
    rows = docs.select(F.xxhash64(key, as_text()).alias("row"), F.col(key).alias("key"), as_text().alias("text"))
    ranges = covered_bytes(rows.select("row", "text"), length, **options)
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body = zlib.decompress(body)
                gone = _merged(((r["first"], r["last"]) for r in found or ()), len(body))
                edges = [0, *(x for pair in gone for x in pair), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(columns, (len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:len(names) - 1]], names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    joined = _packed(rows.select("row", "key", "text")).join(lists, "row", "left").select("key", "body", "ranges")
    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                             + ", kept binary" * with_bytes)
