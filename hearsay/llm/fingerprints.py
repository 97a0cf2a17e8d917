"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A fingerprint keeps the ``k`` smallest distinct 48-bit hashes of a text's shingles.  The
fingerprint of several texts together is the ``k`` smallest of theirs, so sketches of
parts can be merged.  From them follow resemblance, containment and the number of distinct
shingles; with fewer than ``k`` shingles all three are exact.

A text of one to four words has one shingle; a null or empty text has none, and its
likeness is 1 to another such text and 0 to any other.  Repeated rows are fingerprinted
each; other columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import Hasher, chunks, flat, shingles, words

K = 128
SHINGLE_WORDS = 5
_SPACE = float(1 << 48)
ROWS_PER_RANGE = 2_000
MOST_RANGES = 20_000
_TEXTS_AT_ONCE = 2 << 20


# --- one sketch ----------------------------------------------------------------


def encode(hashes: np.ndarray) -> str:
    big = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(big.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], 1).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The Jaccard similarity of two shingle sets, from the smallest hashes of their union."""
    if not len(a) and not len(b):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    if not len(both):
        return 0.0
    union = np.union1d(a, b)[:k]
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of ``a``'s shingles that ``b`` has as well."""
    if not len(a):
        return 1.0
    together = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, together / distinct(a, k))


def sketches(column: pa.Array, k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The bottom-k sketch of every text of an Arrow column."""
    data, limits = flat(column)
    out: list[np.ndarray] = []
    for first, last, part, ends in chunks(data, limits):
        for a in range(0, last - first, 60_000):  # text numbers take 16 bits of a key
            b = min(a + 60_000, last - first)
            piece, cuts = part[ends[a]:ends[b]], ends[a:b + 1] - ends[a]
            starts, stops, owner = words(piece, cuts)
            found, owner = shingles(Hasher(piece).ranges(starts, stops), owner, size)
            keys = np.unique((owner.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16)))
            at = np.searchsorted(keys, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(48))
            low = keys & np.uint64((1 << 48) - 1)
            out.extend(low[at[i]:min(at[i] + k, at[i + 1])] for i in range(b - a))
    return out


# --- tables --------------------------------------------------------------------


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = K) -> DataFrame:
    """``key, fingerprint, n_shingles`` (an estimate) for every row of ``docs(key, text)``."""
    taken = docs.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(encode, found), pa.string()), pa.array([distinct(f, k) for f in found], pa.float64())],
                names=[key, "fingerprint", "n_shingles"])

    return taken.mapInArrow(run, f"`{key}` {dict(taken.dtypes)[key]}, fingerprint string, n_shingles double")


def merged(prints: DataFrame, by: str, key: str = "doc_id", k: int = K, salts: int = 64) -> DataFrame:
    """``by, fingerprint`` of all fingerprints of a group, first merged within salted parts of it."""

    def smallest(rows: DataFrame, *keys: str) -> DataFrame:
        joined = rows.groupBy(*keys).agg(F.collect_list("fingerprint").alias("parts"))
        return joined.withColumn("fingerprint", union("parts")).drop("parts")

    @F.pandas_udf("string")
    def union(column):
        return column.map(lambda parts: encode(np.unique(np.concatenate([decode(p) for p in parts]))[:k]))

    salted = prints.select(by, "fingerprint", F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"))
    fine = salted.withColumn("cell", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    return smallest(smallest(smallest(fine, by, "salt", "cell"), by, "salt"), by)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the following one."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def compare_with_next(docs: DataFrame, key: str = "doc_id", k: int = K) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next text's, by ``key``.

    Rows are dealt into ranges of the key; the first row of a range is also given to the
    range before it (and the first of all to the last), so every row meets the next one
    within its task.  Rows of one key are in the order of their texts, a null key is first.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE + 1)
    # Limits from a hash sample of some 50 keys a range; they only have to be about even.
    place = F.crc32(F.concat(F.lit("range"), F.col("key").cast("string"))) / 4294967296.0
    sample = sorted(r[0] for r in rows.filter(place * n < 50 * ranges).select("key").collect() if r[0] is not None)
    limits = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def range_of(keys):
        return keys.map(lambda v: bisect.bisect_right(limits, v))

    # A null key goes where the least one would; pandas would turn its neighbours into floats.
    least = F.lit({"int": -(1 << 31), "bigint": -(1 << 63)}.get(kind, "")).cast(kind)
    dealt = rows.withColumn("range", range_of(F.coalesce("key", least)) if limits else F.lit(0))
    # One row per range, which are bounded in number.
    firsts = {r["range"]: r["least"] for r in dealt.groupBy("range").agg(
        F.when(F.count("key") == F.count("*"), F.min("key")).alias("least")).collect()}
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    heads = spark.createDataFrame([(r, firsts[r], before[r]) for r in order], f"range int, least {kind}, before int")
    head = rows.join(F.broadcast(heads), F.col("key").eqNullSafe(F.col("least")))
    extra = head.groupBy(F.col("before").alias("range")).agg(F.min(F.struct("key", "text")).alias("row")).select(
        "range", F.lit(1).alias("extra"), "row.key", "row.text")
    every = dealt.select("range", F.lit(0).alias("extra"), "key", "text").unionByName(extra)
    lined = every.repartition(ranges, "range").sortWithinPartitions("range", "extra", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.select(["extra", "key", "text"]).columns)):
                held.append(row)
                weight += len(row[2])
                if weight > _TEXTS_AT_ONCE or len(held) >= 20_000:
                    yield compared(held)
                    held, weight = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield compared(held)

    def compared(held: list) -> pa.RecordBatch:
        texts = [text for _, _, text in held]
        own = sketches(pa.array(texts, pa.large_string()), k)
        live = [i for i in range(len(held) - 1) if not held[i][0]]
        edited = [edited_text(texts[i], texts[i + 1]) for i in live]
        changed = sketches(pa.array(edited, pa.large_string()), k)
        return pa.RecordBatch.from_arrays([
            pa.array([held[i][1] for i in live], schema_type),
            pa.array([len(texts[i]) for i in live], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([encode(own[i]) for i in live], pa.string()),
            pa.array([encode(c) for c in changed], pa.string()),
            pa.array([resemblance(own[i], c, k) for i, c in zip(live, changed)], pa.float64()),
            pa.array([resemblance(own[i], own[i + 1], k) for i in live], pa.float64()),
            pa.array([distinct(own[i], k) for i in live], pa.float64()),
            pa.array([containment(own[i], c, k) for i, c in zip(live, changed)], pa.float64()),
        ], names=names)

    schema_type = pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "n_shingles", "in_edited"]
    return lined.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, "
                                 "n_shingles double, in_edited double")
