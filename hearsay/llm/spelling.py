"""Spelling variants: words one edit away from a more frequent word, and the word they go back to.

Words are runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of ``LEAST_LENGTH`` letters
and ``LEAST_COUNT`` occurrences or more.  To give the operator something to find, a part of the runs loses a
letter first, chosen by a hash of document and run.

Two words are near if one inserted, deleted or replaced letter makes one the other.  Then they agree
in the first or the last half of the shorter one's length, so every word is given to blocks by
(length of the shorter one, side, half) in both roles, as the shorter and as the longer one.  Blocks
of more than ``CHUNK`` words are cut into chunks, and all words of the block meet every chunk; small
blocks of a length share a bucket.  A bucket is searched with a bit-sliced position index: for
every (position, letter) a bitset over its words.  All of the bucket's words are matched at once, letter by letter: one
bitset tracks the words met without error, three those met with one error, that is a letter replaced, or an
insertion or deletion, whose positions are shifted by one from then on.

A pair counts in the block of its first half if the halves agree there, else in that of the last, so once.
Per word only the number of near words and the best of them leave a bucket; pairs are never
listed.  Ties go to the least word in code-point order.

Null texts and empty ones have no words; a null key counts as an empty one.  Repeated rows count as often as
they occur.  Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import run_starts
from hearsay.llm.tables import as_text, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGED = 97  # one in so many runs of a document loses a letter
CHUNK = 2048  # words of a bitset
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Letters as numbers from 1 on: a to z, then U+00C0 to U+00FF.
_CODES = np.zeros(256, dtype=np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[0xC0:] = np.arange(27, 91)
_LETTERS = 91
PREFIX, SUFFIX = 0, 1


# --- vocabulary -----------------------------------------------------------------------------


def damaged(key: str, run: str, rate: int = DAMAGED) -> str:
    """The run, without one letter if its hash says so; ``rate`` 0 leaves all runs as they are."""
    if not rate:
        return run
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT,
               rate: int = DAMAGED) -> DataFrame:
    """``word, n``: the words of all texts of ``docs(key, text)`` with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    held[damaged(name, found, rate)] += n
            rows = [(w, n) for w, n in held.items() if len(w) >= least_length]
            if rows:
                word, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), as_text().alias("text"))
    counted = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


# --- blocks ---------------------------------------------------------------------------------


def blocks(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``bucket, size, side, half, listed, word, n``: every word in its blocks, blocks in buckets.

    ``size`` is the length of the shorter word of a pair.  A bucket lists (``listed``) some ``chunk``
    words of one ``size``; a block that is larger is cut, and all its words are asked of every chunk.
    """
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("size")
    sized = words.select("word", "n", size)
    half = F.floor(F.col("size") / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.substring("word", F.char_length("word") - half + 1, half)
    sides = F.explode(F.array(F.struct(F.lit(PREFIX).alias("side"), first.alias("half")),
                              F.struct(F.lit(SUFFIX).alias("side"), last.alias("half")))).alias("at")
    placed = sized.select("word", "n", "size", sides).select("word", "n", "size", "at.side", "at.half")
    counts = placed.groupBy("size", "side", "half").agg(F.count("*").alias("words")).filter("words > 1")
    per_size = counts.groupBy("size").agg(F.sum("words").alias("all"))
    # A block of one word holds no pair.  Long words make wide indexes, so fewer of them share one.
    room = F.greatest(F.lit(16), F.least(F.lit(chunk), F.lit(chunk * 64) / F.col("size"))).cast("int")
    counts = counts.join(per_size, "size").withColumn("room", room).withColumn(
        "chunks", F.ceil(F.col("words") / F.col("room")).cast("int")).withColumn(
        "buckets", F.ceil(F.col("all") / F.col("room")).cast("int"))
    met = placed.join(counts, ["size", "side", "half"])
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    dealt = met.select("word", "n", "size", "side", "half", "buckets", "chunks", own.alias("own"),
                       F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    small = F.pmod(F.xxhash64("side", "half"), F.col("buckets"))
    large = F.xxhash64("side", "half", "chunk")
    return dealt.select(F.when(F.col("chunks") > 1, large).otherwise(small).alias("bucket"), "size", "side", "half",
                        (F.col("own") == F.col("chunk")).alias("listed"), "word", "n")


# --- the index ------------------------------------------------------------------------------


def lettered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers, one row a word, 0 behind its end; and lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(lengths.max(initial=0)) + 2), dtype=np.uint8)
    body = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    rows = np.repeat(np.arange(len(words)), lengths)
    out[rows, np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = _CODES[body]
    return out, lengths


def _bits(chosen: np.ndarray) -> np.ndarray:
    """Truth values along the last axis as bitsets of 64-bit words."""
    gap = -chosen.shape[-1] % 64
    padded = np.concatenate([chosen, np.zeros((*chosen.shape[:-1], gap), dtype=bool)], axis=-1) if gap else chosen
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class PositionIndex:
    """Bitsets over ``words`` for every (position, letter), made position by position."""

    def __init__(self, words: list[str]):
        self._letters, lengths = lettered(words)
        self.n, self.width = len(words), self._letters.shape[1]
        self._lengths = lengths
        self._made: dict[int, np.ndarray] = {}

    def at(self, position: int) -> np.ndarray:
        """By letter, the words that have it there; only the last few positions are kept."""
        if position not in self._made:
            column = self._letters[:, position] if 0 <= position < self.width else np.zeros(self.n, dtype=np.uint8)
            sets = _bits(column[None] == np.arange(_LETTERS, dtype=np.uint8)[:, None])
            sets[0] = 0  # behind the end there is no letter
            self._made[position] = sets
            self._made.pop(position - 4, None)
        return self._made[position]

    def long(self, lengths: np.ndarray) -> np.ndarray:
        """For every length, the words that have it."""
        return _bits(self._lengths[None] == lengths[:, None])

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs of a given word and a word of the index that are one edit apart."""
        letters, lengths = lettered(words)
        nothing = np.zeros((len(words), -(-self.n // 64)), dtype=np.uint64)
        exact = nothing.copy()
        exact[:] = _bits(np.ones(self.n, dtype=bool))
        replaced, extra, lacking = nothing.copy(), nothing.copy(), nothing.copy()
        found = nothing.copy()
        longest = int(lengths.max(initial=0))
        for i in range(longest + 1):
            done = np.flatnonzero(lengths == i)
            if len(done):  # these words are matched to their end
                own = lengths[done]
                # A word of the index may have its additional letter at its very end.
                found[done] = (replaced[done] & self.long(own)) | ((extra[done] | exact[done]) & self.long(own + 1)) \
                    | (lacking[done] & self.long(own - 1))
            if i == longest:
                break
            letter = letters[:, i]
            here = self.at(i)[letter]
            before = self.at(i - 1)[letter] if i else nothing
            behind = self.at(i + 1)[letter]
            replaced = (replaced & here) | (exact & ~here)
            extra = (extra | exact) & behind  # the index word has one letter more, before position i + 1
            lacking = (lacking & before) | exact  # the index word lacks this letter
            exact &= here
        i, j = [], []
        for a in range(0, len(words), 1024):
            rows = np.unpackbits(found[a:a + 1024].view(np.uint8), axis=1, count=self.n, bitorder="little")
            x, y = np.nonzero(rows)
            i.append(x + a)
            j.append(y)
        return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Words:
    """Rows of a bucket: words with their counts, and the blocks they are in."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.size = table.column("size")[0].as_py()
        self.words, self.n = table.column("word").to_pylist(), table.column("n").to_numpy()
        self.lengths = np.array([len(w) for w in self.words])
        self.blocks = list(zip(table.column("side").to_pylist(), table.column("half").to_pylist()))
        self.starts = [w[:self.size // 2] for w in self.words]


def _bucket_links(index: PositionIndex, own: _Words, asked: _Words) -> pa.RecordBatch:
    """``word, n_near, form_n, form`` of the asked words that have near words among a bucket's own."""
    i, j = index.near(asked.words)
    # The words must share the block, and in a block of endings not the half before.
    fits = np.minimum(asked.lengths[i], own.lengths[j]) == own.size
    for k in np.flatnonzero(fits).tolist():
        block = asked.blocks[i[k]]
        fits[k] = block == own.blocks[j[k]] and (block[0] == PREFIX or asked.starts[i[k]] != own.starts[j[k]])
    i, j = i[fits], j[fits]
    rank = np.empty(len(own.words), dtype=np.int64)
    rank[sorted(range(len(own.words)), key=own.words.__getitem__)] = np.arange(len(own.words))
    order = np.lexsort((rank[j], -own.n[j], i))
    i, j = i[order], j[order]
    begins = run_starts(i)
    best = j[begins]
    return pa.RecordBatch.from_arrays([
        pa.array([asked.words[k] for k in i[begins].tolist()], pa.string()), pa.array(np.diff(np.append(begins, len(i))), pa.int64()),
        pa.array(own.n[best], pa.int64()), pa.array([own.words[k] for k in best.tolist()], pa.string())],
        names=["word", "n_near", "form_n", "form"])


def _room(size: int, chunk: int) -> int:
    """So many words of a length fit an index, as many are asked at a time."""
    return max(16, min(chunk, chunk * 64 // max(size, 1)))


def _bucket_results(rows: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The links of one bucket, whose ``rows`` begin with those that are listed."""
    listed, asked, waiting, index, own = [], [], 0, None, None
    for batch in rows:
        stop = int(np.count_nonzero(batch.column("listed").to_numpy(zero_copy_only=False)))
        if stop:
            listed.append(batch.slice(0, stop))
        if stop == len(batch):
            continue
        if index is None:
            own = _Words(listed) if listed else None
            index = PositionIndex(own.words) if listed else False
            if own:
                yield _bucket_links(index, own, own)
        if own is None:
            continue
        asked.append(batch.slice(stop))
        waiting += len(asked[-1])
        while waiting >= _room(own.size, chunk):
            together = pa.Table.from_batches(asked)
            part = together.slice(0, _room(own.size, chunk))
            yield _bucket_links(index, own, _Words(part.to_batches()))
            asked = together.slice(len(part)).to_batches()
            waiting -= len(part)
    if index is None and listed:
        own = _Words(listed)
        yield _bucket_links(PositionIndex(own.words), own, own)
    elif waiting:
        yield _bucket_links(index, own, _Words(asked))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where another bucket begins."""
    for batch in batches:
        size, bucket = batch.column("size").to_numpy(), batch.column("bucket").to_numpy()
        cuts = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (size[1:] != size[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            if a < b:
                yield (size[a], bucket[a]), batch.slice(a, b - a)


def links(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word, n_near, form, form_n``: how many words of ``words(word, n)`` are near, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_runs(batches), key=lambda run: run[0]):
            yield from _bucket_results((batch for _, batch in rows), chunk)

    dealt = blocks(words, chunk).repartition("size", "bucket").sortWithinPartitions("size", "bucket", F.desc("listed"))
    pairs = dealt.select("bucket", "size", "side", "half", "listed", "word", "n").mapInArrow(
        run, "word string, n_near bigint, form_n bigint, form string")
    # The most occurrences, then the least word: the least of its negative count and itself.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    summed = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: every word's last form.  A form is twice as frequent as its word at
    least, so ways are short; every round doubles the steps, from tables in the shared folder."""
    ways = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                   F.col("next").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT,
             rate: int = DAMAGED, chunk: int = CHUNK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for all words of ``docs(key, text)``."""
    words = written(vocabulary(docs, key, least_length, least, rate), "vocabulary")
    near = words.join(links(words, chunk), "word", "left")
    known = F.col("form_n") >= 2 * F.col("n")
    linked = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                 F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n")), "links")
    last = roots(linked.filter("form IS NOT NULL"))
    return linked.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
