"""Packing documents into sequences of several permitted lengths, best-fit.

Sizes are words.  Texts longer than the longest sequence are cut into pieces of that
length and a rest, so that no word is lost.  Pieces are packed in decreasing size: into
the open bin with the least room that suffices, else into a new bin.  Its length is the
permitted one of least cost per word, found by filling a trial bin of every length from
the pieces still to come.  At the end every bin shrinks to the shortest permitted length
that holds its contents.

Packing runs per shard; a shard is a bounded number of pieces by a hash of the document, so
shards are even whatever the sources are, and their number grows with the table.  Texts
of no words (null, empty) take no room: they keep a row with no bin.  Repeated rows are
packed as separate documents.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import WORD, as_text, shared_folder, written

LENGTHS = (512, 1024, 2048, 4096)
BIN_COST = 64  # words of padding that one more sequence is worth
ATTENTION = 65_536  # length at which attention costs as much as all other work
SHARD_PIECES = 20_000
REPEATS = 256  # of one row that stay together


def cost(length: int, bin_cost: float = BIN_COST) -> float:
    """Of one sequence, in words of work."""
    return length + length * length / ATTENTION + bin_cost


class _Sizes:
    """A multiset of whole numbers up to ``top`` that finds the largest one not above a limit."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.bits = sum(1 << size for size, n in enumerate(self.counts) if n)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits &= ~(1 << size)

    def largest(self, limit: int) -> int:
        return (self.bits & ((2 << limit) - 1)).bit_length() - 1

    def trial(self, first: int, length: int) -> int:
        """Words in a bin of ``length`` that holds ``first`` and is then filled greedily."""
        room, used = length - first, {first: 1}
        bits = self.bits
        while room > 0:
            size = (bits & ((2 << room) - 1)).bit_length() - 1
            if size <= 0:
                break
            if self.counts[size] - used.get(size, 0) <= 0:
                bits &= ~(1 << size)
                continue
            used[size] = used.get(size, 0) + 1
            room -= size
        return length - room


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST):
    """Bin number and place of every size, and the final length and content of every bin."""
    lengths = sorted(lengths)
    top = lengths[-1]
    sizes = np.asarray(sizes, dtype=np.int64)
    left = _Sizes(np.bincount(sizes, minlength=top + 1))
    order = np.argsort(-sizes, kind="stable")
    bin_of, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin with room r is open
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            bins = by_room[room]
            at = bins.pop()
            if not bins:
                rooms &= ~(1 << room)
        else:
            costs = [(cost(length, bin_cost) / left.trial(size, length), length) for length in lengths if length >= size]
            room, at = min(costs)[1], len(filled)
            filled.append(0)
        left.take(size)
        bin_of[i], start[i] = at, filled[at]
        filled[at] += size
        room -= size
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    content = np.asarray(filled, dtype=np.int64)
    return bin_of, start, np.asarray(lengths)[np.searchsorted(lengths, content)], content


def pieces(docs: DataFrame, key: str = "doc_id", longest: int = LENGTHS[-1]) -> DataFrame:
    """``key, row, piece, first_word, n_words``: whole texts in pieces of at most ``longest`` words."""
    counted = docs.select(
        F.col(key), F.xxhash64(as_text()).alias("text_hash"),
        F.regexp_count(as_text(), F.lit(WORD)).cast("bigint").alias("size"),
    )
    last = F.greatest(F.floor((F.col("size") - 1) / longest), F.lit(0)).cast("int")
    return counted.select(key, "text_hash", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        key, "text_hash", "piece", (F.col("piece") * F.lit(longest).cast("bigint")).alias("first_word"),
        F.least(F.lit(longest).cast("bigint"), F.col("size") - F.col("piece") * F.lit(longest)).alias("n_words"),
    )


def pack(docs: DataFrame, key: str = "doc_id", lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: ``key, piece, first_word, n_words, bin_id, start, bin_length, bin_words``."""
    spark = docs.sparkSession
    same = pieces(docs, key, max(lengths)).groupBy(key, "text_hash", "piece", "first_word", "n_words")
    cut = written(same.agg(F.count("*").alias("rows")), "pieces")
    shards = max(1, -(-(cut.agg(F.sum("rows")).first()[0] or 0) // shard_pieces))
    names = [key, "piece", "first_word", "n_words"]
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, piece int, first_word bigint, n_words bigint, bin_id string, start bigint, " \
             "bin_length bigint, bin_words bigint"

    def one_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(part["rows"])].sort_values(
            ["n_words", key, "piece", "text_hash"], ascending=[False, True, True, True])
        packed = part["n_words"].to_numpy() > 0
        bin_of, start, length, content = best_fit(part["n_words"].to_numpy()[packed], lengths, bin_cost)
        shard, out = int(part["shard"].iloc[0]), part[names].copy()
        for name, values in (("start", start), ("bin_length", length[bin_of]), ("bin_words", content[bin_of])):
            column = pd.array([pd.NA] * len(out), dtype="Int64")
            column[packed] = values
            out[name] = column
        ids = np.full(len(out), None, dtype=object)
        ids[packed] = [f"{shard}-{b}" for b in bin_of]
        out["bin_id"] = ids
        return out[[*names, "bin_id", "start", "bin_length", "bin_words"]]

    # Repeats of one row are dealt in blocks, so that they need not meet in one shard.
    blocks = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / REPEATS).cast("int"))))
    dealt = blocks.withColumn("rows", F.least(F.lit(REPEATS), F.col("rows") - F.col("block") * REPEATS)).withColumn(
        "shard", F.pmod(F.xxhash64(key, "piece", "text_hash", "block"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one_shard, schema)


def sequences(docs: DataFrame, placed: DataFrame, key: str = "doc_id", separator: str = " ") -> DataFrame:
    """``bin_id, bin_length, bin_words, keys, text``: the words of every bin in order; for unique keys."""
    words = F.regexp_extract_all(as_text(), F.lit(f"({WORD})"))
    taken = docs.select(key, words.alias("words")).join(placed.filter("bin_id IS NOT NULL"), key).select(
        "bin_id", "bin_length", "bin_words", "start", F.col(key).alias("key"),
        F.array_join(F.expr("slice(words, int(first_word) + 1, int(n_words))"), separator).alias("text"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("start", "key", "text")))
    return taken.groupBy("bin_id", "bin_length", "bin_words").agg(in_order.alias("parts")).select(
        "bin_id", "bin_length", "bin_words", F.col("parts.key").alias("keys"),
        F.array_join(F.col("parts.text"), separator).alias("text"),
    )
