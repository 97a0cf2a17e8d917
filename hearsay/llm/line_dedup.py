"""Lines that many documents share are dropped, and come back when those documents go.

A line's key is the line without white space around it, A-Z lower-cased; keys are told
apart by 128-bit BLAKE2 digests.  An index over a set of documents has two parts:

* reference counts, exact: one row per key with the number of documents that hold it;
* cuckoo filters, one per shard of the keys: the fingerprints of the frequent keys, those
  of ``least`` documents or more.  With a filter goes the exact list of the shard's
  other keys that it lets through by mistake, taken from the reference counts, so that a
  filter answers exactly for every key that was counted.

Documents are inserted and deleted in batches: counts are added up by key, and in the
shards concerned fingerprints of keys that became frequent are put in and of those that
no longer are taken out.  An index after an insertion and the deletion of the same
documents answers as before.  Deleting what was never inserted is an error.  Shards are
split when they outgrow ``SHARD_KEYS`` keys, by building their filters anew from the counts.

Cleaning reads every text once and shuffles none: all filters are broadcast while they are
within ``FILTER_BYTES``.  Beyond that, digests of lines are joined to the frequent keys.

Every row is a document, repeated rows count as often as they occur, and a document counts
once for a key that it has in several lines.  Null texts count as empty, which is one
empty line.  Empty keys are never counted.  Only lines that are frequent go, all of them
or none, so ties do not arise.  Other columns are left out unless carried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import LOWER, mixed
from hearsay.llm.tables import as_text, written

LEAST_DOCUMENTS = 10
SHARD_KEYS = 1 << 18
FILTER_BYTES = 64 << 20
SLOTS = 4
LOAD = 0.85
_KICKS = 200
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()
_FILTER = "shard INT, slots BINARY, mistaken BINARY"


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).translate(_LOWER)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The digests' first and last eight bytes as numbers."""
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


# --- the filter --------------------------------------------------------------------------


def _marks(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints; 0 stands for a free slot."""
    return np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def _apart(marks: np.ndarray) -> np.ndarray:
    """What lies between a fingerprint's two buckets."""
    return mixed(marks.astype(np.uint64))


class CuckooFilter:
    """A set of 64-bit hashes by fingerprints of 16 bits, four to a bucket; a hash has two buckets.

    All operations take arrays.  A hash that was put in is always found; of others about one in
    8,000 is found by mistake.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self._mask = np.uint64(len(slots) - 1)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(hashes)) / (SLOTS * LOAD)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), dtype=np.uint16))
            if made.insert(hashes):
                return made
            buckets *= 2

    @classmethod
    def read(cls, body: bytes) -> CuckooFilter:
        return cls(np.frombuffer(body, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.slots.tobytes()

    def _settled(self, marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints where their bucket has room; the others, with their other bucket."""
        order = np.argsort(at, kind="stable")
        marks, at = marks[order], at[order]
        begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        free = self.slots[at] == 0
        wanted = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        fits = wanted.any(1)
        self.slots[at[fits], wanted[fits].argmax(1)] = marks[fits]
        marks, at = marks[~fits], at[~fits]
        return marks, (at ^ _apart(marks)) & self._mask

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; it is of no use then."""
        draw = np.random.default_rng(len(hashes))
        marks, at = _marks(hashes), hashes & self._mask
        for _ in range(_KICKS):
            for _ in range(2):
                if not len(marks):
                    return True
                marks, at = self._settled(marks, at)
            # No room in either bucket: one waiting fingerprint a bucket drives out another.
            _, one = np.unique(at, return_index=True)
            slot = draw.integers(0, SLOTS, len(one))
            driven = self.slots[at[one], slot]
            self.slots[at[one], slot] = marks[one]
            marks[one] = driven
            at[one] = (at[one] ^ _apart(driven)) & self._mask
        return not len(marks)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were put in; of equal fingerprints one for each."""
        marks, at = _marks(hashes), hashes & self._mask
        while len(marks):
            other = (at ^ _apart(marks)) & self._mask
            _, one = np.unique(np.stack([np.minimum(at, other), marks.astype(np.uint64)]), axis=1, return_index=True)
            places = np.stack([at[one], other[one]], axis=1)
            found = (self.slots[places] == marks[one][:, None, None]).reshape(len(one), 2 * SLOTS)
            if not found.any(1).all():
                raise ValueError("a line is deleted that is not in the filter")
            slot = found.argmax(1)
            self.slots[places[np.arange(len(one)), slot // SLOTS], slot % SLOTS] = 0
            marks, at = np.delete(marks, one), np.delete(at, one)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        marks, at = _marks(hashes), hashes & self._mask
        other = (at ^ _apart(marks)) & self._mask
        return ((self.slots[at] == marks[:, None]) | (self.slots[other] == marks[:, None])).any(1)


class Frequent:
    """All shards' filters and their mistaken keys at once: tells which digests are frequent."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], bits: int):
        self._bits = bits
        sizes = np.ones(1 << bits, dtype=np.int64)
        starts = np.zeros(1 << bits, dtype=np.int64)
        tables, size = [np.zeros((1, SLOTS), dtype=np.uint16)], 1  # shards without a filter share an empty bucket
        for shard, slots, _ in rows:
            tables.append(np.frombuffer(slots, dtype=np.uint16).reshape(-1, SLOTS))
            sizes[shard], starts[shard] = len(tables[-1]), size
            size += len(tables[-1])
        self._slots = np.concatenate(tables)
        self._masks, self._starts = (sizes - 1).astype(np.uint64), starts
        self._mistaken = {m[i:i + 16] for _, _, m in rows for i in range(0, len(m), 16)}
        self._lows = np.sort(halves(list(self._mistaken))[1]) if self._mistaken else np.zeros(0, np.uint64)

    def has(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, dtype=bool)
        high, low = halves(digests)
        shard = (high >> np.uint64(64 - self._bits)).astype(np.int64) if self._bits else np.zeros(len(high), np.int64)
        marks, masks, starts = _marks(low), self._masks[shard], self._starts[shard]
        at = low & masks
        other = (at ^ _apart(marks)) & masks
        found = np.zeros(len(low), dtype=bool)
        for place in (at, other):
            found |= (self._slots[starts + place.astype(np.int64)] == marks[:, None]).any(1)
        if len(self._lows):
            near = np.minimum(np.searchsorted(self._lows, low), len(self._lows) - 1)
            for i in np.flatnonzero(found & (self._lows[near] == low)).tolist():
                found[i] = digests[i] not in self._mistaken
        return found


# --- the index ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """``counts(high, low, n)`` and ``filters(shard, slots, mistaken)`` of ``2 ** bits`` shards."""

    counts: DataFrame
    filters: DataFrame
    bits: int
    least: int


def line_counts(docs: DataFrame) -> DataFrame:
    """``high, low, n``: the digests of the keys of ``docs(text)`` and how many documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[bytes] = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update({line_key(line) for line in text.split(b"\n")})
            held.pop(b"", None)
            if held:
                high, low = halves([digest(key) for key in held])
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                                                  pa.array(list(held.values()), pa.int64())], names=["high", "low", "n"])

    found = docs.select(as_text().alias("text")).mapInArrow(run, "high bigint, low bigint, n bigint")
    return found.groupBy("high", "low").agg(F.sum("n").alias("n"))


def _sharded(counts: DataFrame, bits: int) -> DataFrame:
    shard = F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)
    return counts.withColumn("shard", shard)


def _bits(counts: DataFrame, shard_keys: int) -> int:
    return max(0, (max(0, counts.count() - 1) // shard_keys).bit_length())


def _row(shard: int, made: CuckooFilter, table: pa.Table, frequent: np.ndarray) -> pa.Table:
    """A shard's filter with the keys of ``table`` that it lets through though they are not frequent."""
    high, low = (table.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    mistaken = np.flatnonzero(~frequent & made.has(low)) if len(low) else np.zeros(0, np.int64)
    listed = np.stack([high[mistaken], low[mistaken]], axis=1).astype("<u8").tobytes()
    return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([made.write()], pa.binary()),
                     "mistaken": pa.array([listed], pa.binary())})


def _built(counts: DataFrame, bits: int, least: int) -> DataFrame:
    """A filter for every shard, from the counts; a shard has some ``SHARD_KEYS`` keys."""

    def make(key, table):
        frequent = table.column("n").to_numpy() >= least
        made = CuckooFilter.of(table.column("low").to_numpy().view(np.uint64)[frequent])
        return _row(key[0].as_py(), made, table, frequent)

    return _sharded(counts, bits).groupBy("shard").applyInArrow(make, _FILTER)


def build(docs: DataFrame, least: int = LEAST_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index of ``docs(text)``; lines of ``least`` documents or more are frequent."""
    counts = written(line_counts(docs), "line-counts")
    bits = _bits(counts, shard_keys)
    return LineIndex(counts, written(_built(counts, bits, least), "line-filters"), bits, least)


def insert(index: LineIndex, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    return _changed(index, line_counts(docs), shard_keys)


def delete(index: LineIndex, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    return _changed(index, line_counts(docs).withColumn("n", -F.col("n")), shard_keys)


def _changed(index: LineIndex, change: DataFrame, shard_keys: int) -> LineIndex:
    before = index.counts.select("high", "low", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("n"))
    after = change.select("high", "low", F.lit(0).cast("bigint").alias("old"), "n")
    merged = before.unionByName(after).groupBy("high", "low").agg(
        F.sum("old").alias("old"), (F.sum("old") + F.sum("n")).alias("n"))
    merged = written(_sharded(merged, index.bits), "line-counts")
    if not merged.filter("n < 0").isEmpty():
        raise ValueError("a document is deleted that was not inserted")
    counts = merged.filter("n > 0").select("high", "low", "n")
    bits, least = _bits(counts, shard_keys), index.least
    if bits > index.bits:
        return LineIndex(counts, written(_built(counts, bits, least), "line-filters"), bits, least)

    def change_shard(key, table, old):
        low, n, was = (table.column(c).to_numpy() for c in ("low", "n", "old"))
        hashes, frequent, before = low.view(np.uint64), n >= least, was >= least
        if old.num_rows:
            made = CuckooFilter.read(old.column("slots")[0].as_py())
            made.delete(hashes[before & ~frequent])
            whole = made.insert(hashes[frequent & ~before])
        if not old.num_rows or not whole:
            made = CuckooFilter.of(hashes[frequent])
        stays = n > 0
        return _row(key[0].as_py(), made, table.filter(pa.array(stays)), frequent[stays])

    touched = merged.filter("n <> old").select("shard").distinct()
    rows = merged.join(touched, "shard", "semi").groupBy("shard")
    filters = rows.cogroup(index.filters.join(touched, "shard", "semi").groupBy("shard")).applyInArrow(change_shard, _FILTER)
    kept = index.filters.join(touched, "shard", "anti")
    return LineIndex(counts, written(filters.unionByName(kept), "line-filters"), index.bits, least)


# --- cleaning ----------------------------------------------------------------------------


def clean(docs: DataFrame, index: LineIndex, carry: tuple[str, ...] = ("doc_id",), filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``carry..., n_lines, n_dropped, kept``: the texts of ``docs`` without their frequent lines.

    The documents are among those the index holds; others are inserted first.
    """
    size = index.filters.agg(F.sum(F.octet_length("slots") + F.octet_length("mistaken"))).first()[0] or 0
    if size > filter_bytes:
        return _cleaned_by_join(docs, index, carry)
    rows = [(r["shard"], bytes(r["slots"]), bytes(r["mistaken"])) for r in index.filters.collect()]
    shared, bits = docs.sparkSession.sparkContext.broadcast(rows), index.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(shared.value, bits)
        for batch in batches:
            texts = [t.split(b"\n") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            known = {key: i for i, key in enumerate({line_key(line) for lines in texts for line in lines} - {b""})}
            drops = np.append(frequent.has([digest(key) for key in known]), False).tolist()
            kept = [[line for line in lines if not drops[known.get(line_key(line), -1)]] for lines in texts]
            yield _result(batch, texts, kept)

    return _mapped(docs.select(as_text().alias("text"), *(F.col(f"`{c}`") for c in carry)), run, carry)


def _result(batch: pa.RecordBatch, texts: list[list[bytes]], kept: list[list[bytes]]) -> pa.RecordBatch:
    bodies = pa.array([b"\n".join(lines) for lines in kept], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(map(len, texts), pa.int64()),
                                       pa.array([len(a) - len(b) for a, b in zip(texts, kept)], pa.int64()), bodies],
                                      names=[*batch.schema.names[1:], "n_lines", "n_dropped", "kept"])


def _mapped(rows: DataFrame, run, carry: tuple[str, ...]) -> DataFrame:
    kinds = dict(rows.dtypes)
    carried = "".join(f"`{c}` {kinds[c]}, " for c in carry)
    return rows.mapInArrow(run, f"{carried}n_lines bigint, n_dropped bigint, kept string")


def _cleaned_by_join(docs: DataFrame, index: LineIndex, carry: tuple[str, ...]) -> DataFrame:
    """As ``clean``, where the filters are too large to be broadcast: texts are shuffled once, by their hash."""
    texts = docs.select(as_text().alias("text"), *(F.col(f"`{c}`") for c in carry))
    body = F.sha2("text", 256)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                keys = [line_key(line) for line in text.split(b"\n")]
                at = [i for i, key in enumerate(keys) if key]
                if at:
                    high, low = halves([digest(keys[i]) for i in at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(high.view(np.int64)),
                         pa.array(low.view(np.int64))], names=["body", "place", "high", "low"])

    asked = texts.select("text", body.alias("body")).mapInArrow(places, "body string, place bigint, high bigint, low bigint")
    frequent = index.counts.filter(F.col("n") >= index.least).select("high", "low")
    dropped = asked.join(frequent, ["high", "low"], "semi").groupBy("body").agg(F.collect_set("place").alias("places"))
    marked = texts.withColumn("body", body).join(dropped, "body", "left").select("text", "places", *(F.col(f"`{c}`") for c in carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split(b"\n") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            gone = [set(p or ()) for p in batch.column(1).to_pylist()]
            kept = [[line for i, line in enumerate(lines) if i not in drop] for lines, drop in zip(texts, gone)]
            yield _result(pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:]],
                                                     names=["text", *batch.schema.names[2:]]), texts, kept)

    kinds = dict(texts.dtypes)
    carried = "".join(f"`{c}` {kinds[c]}, " for c in carry)
    return marked.mapInArrow(run, f"{carried}n_lines bigint, n_dropped bigint, kept string")
