"""Phrases whose words go together more often than their parts would have it, per language.

Texts, A-Z lower-cased, are cut into pieces at ``. , ; : ! ?`` and line breaks, and pieces
into words at blanks and tabs.  A suffix pointer is the place of a word; its suffix is at
most ``most_words`` words long and ends with the piece.  Every language has its own words.

* Words are counted first, exactly; with them their 64-bit names are checked to be unique (if
  not, others are taken).
* Suffixes, equal ones of a buffer added up before, are routed by their two leading words.  Where
  both are hot they are routed by one word more, and so on; the hot leading words by themselves go
  the usual way as shortened suffixes, added up per buffer.  So no leading words, however frequent,
  make one task large.  Hot is a word with more than a fraction of a destination's suffixes; there
  are at most ``MOST_HOT`` such words, whatever the corpus.
* At its destination a batch of suffixes goes through a multikey three-way quicksort: a partition is
  split by the word of a pivot at the partition's depth into less, equal and greater.  The
  size of an equal partition is the count of the words that lead it, and it is split further at the
  next word.  Partitions of fewer than ``least`` suffixes are abandoned at once.  All
  partitions of a round are split together.

A candidate is a phrase of 2 to ``most_words`` words that occurs ``least`` times.  Its score is the least
of ``floor(1000000 a a / (l r))`` over its cuts (among equals the first cut).  A candidate that lies in a
longer one of at least half its count is dropped.

Null texts and empty ones have no words, a null language is ``und``.  Repeated rows count as often
as they occur.  Ties in rank go by count, then by the phrase's bytes.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.packed import LOWER, Hasher, chunks, flat, mixed, run_starts, words
from hearsay.llm.tables import as_text, written

MOST_WORDS = 3
LEAST_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50
SUFFIXES = 1 << 20  # of a destination, and of a buffer on the way there
MOST_HOT = 1_000_000
MOST_PARTITIONS = 20_000  # of Spark; one may have several destinations, sorted one after the other
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
_RESULT = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


# --- words --------------------------------------------------------------------------------


def named_words(column: pa.Array, langs: list[str], seed: int) -> Iterator[tuple]:
    """By runs of texts: names of all words, whether the next word is in the same piece, and bytes, starts and ends."""
    data, limits = flat(column)
    own = np.array([int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in langs], dtype=np.uint64)
    for first, _, part, ends in chunks(LOWER[data], limits):
        starts, stops, owner = words(part, ends, _BETWEEN)
        if not len(starts):
            continue
        names = np.maximum(mixed(Hasher(part, seed).ranges(starts, stops) ^ own[first + owner]), np.uint64(1))
        piece = np.cumsum(_ENDS[part])[starts]
        goes_on = np.zeros(len(starts), dtype=bool)
        goes_on[:-1] = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
        yield names, goes_on, part, starts, stops, first + owner


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``id, lang, word, n`` of all words of ``docs(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            held: dict[int, list] = {}
            for names, _, part, starts, stops, owner in named_words(batch.column(0), langs, seed):
                found, first, n = np.unique(names, return_index=True, return_counts=True)
                body = part.tobytes()
                for name, i, k in zip(found.tolist(), first.tolist(), n.tolist()):
                    if name in held:
                        held[name][2] += k
                    else:
                        held[name] = [langs[owner[i]], body[starts[i]:stops[i]], k]
            if held:
                lang, word, n = zip(*held.values())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(held), dtype=np.uint64).view(np.int64)), pa.array(lang, pa.string()),
                                                  pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                                 names=["id", "lang", "word", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "id bigint, lang string, word string, n bigint")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The counted words, under names that tell them all apart, and the names' seed."""
    for seed in range(8):
        table = written(word_counts(docs, seed), "words")
        if table.groupBy("id").agg(F.count("*").alias("words")).filter("words > 1").isEmpty():
            return table, seed
    raise RuntimeError("words could not be told apart by 64 bits")


# --- suffixes -----------------------------------------------------------------------------


def suffixes(names: np.ndarray, goes_on: np.ndarray, most_words: int) -> np.ndarray:
    """One column per word with the names of it and of up to ``most_words - 1`` words behind it, 0 for none."""
    out = np.zeros((most_words, len(names)), dtype=np.uint64)
    out[0] = names
    whole = np.ones(len(names), dtype=bool)
    for k in range(1, most_words):
        whole[:len(names) - k + 1] &= goes_on[k - 1:]
        whole[max(0, len(names) - k):] = False
        out[k, :max(0, len(names) - k)] = np.where(whole[:len(names) - k], names[k:], 0)
    return out[:, out[1] > 0]


def added_up(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns of ``rows`` as one, with the sum of their weights."""
    if not len(weights):
        return rows, weights
    order = np.argsort(_leading(rows, len(rows)), kind="stable")
    rows = rows[:, order]
    changes = np.ones(len(order), dtype=bool)
    changes[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    first = np.flatnonzero(changes)
    return rows[:, first], np.add.reduceat(weights[order], first)


def _leading(rows: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` leading words."""
    out = np.zeros(rows.shape[1], dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[k])
    return out


def routed(rows: np.ndarray, weights: np.ndarray, hot: np.ndarray, destinations: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Destinations, suffixes and weights.  The level, ``destination // destinations + 2``, tells how many
    leading words a suffix is routed by; sizes of partitions are complete from that depth on."""
    most = len(rows)
    is_hot = np.zeros(rows.shape, dtype=bool)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, rows), len(hot) - 1)] == rows
    left = np.arange(rows.shape[1])
    for level in range(2, most + 1):
        lead = is_hot[:level, left].all(0) if level < most else np.zeros(len(left), dtype=bool)
        plain, shortened = rows[:, left[~lead]], rows[:, left[lead]].copy()
        shortened[level:] = 0
        short, sums = added_up(shortened, weights[left[lead]])
        both = np.concatenate([plain, short], axis=1)
        yield (_leading(both, level) % np.uint64(destinations)).astype(np.int64) + (level - 2) * destinations, both, \
            np.concatenate([weights[left[~lead]], sums])
        left = left[lead]
        if level < most:
            left = left[rows[level, left] > 0]


def _block(rows: np.ndarray, weights: np.ndarray) -> bytes:
    """Suffixes in few bytes: numbers in the list of their words."""
    order = np.lexsort(rows[::-1])
    listed, places = np.unique(rows[:, order], return_inverse=True)
    kind = np.uint16 if len(listed) < 1 << 16 else np.uint32
    body = b"".join([np.array([len(listed), len(weights)], dtype=np.int64).tobytes(), listed.tobytes(),
                     places.astype(kind).tobytes(), weights[order].astype(np.int64).tobytes()])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unblock(body: bytes, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    k, n = np.frombuffer(body, dtype=np.int64, count=2)
    listed = np.frombuffer(body, dtype=np.uint64, count=k, offset=16)
    kind = np.dtype(np.uint16 if k < 1 << 16 else np.uint32)
    at = 16 + 8 * int(k)
    places = np.frombuffer(body, dtype=kind, count=most_words * n, offset=at).reshape(most_words, n)
    return listed[places], np.frombuffer(body, dtype=np.int64, offset=at + kind.itemsize * most_words * int(n))


def _blocks(docs: DataFrame, seed: int, hot: np.ndarray, destinations: int, most_words: int) -> DataFrame:
    """``dest, body``: the suffixes of ``docs(text, lang)``, added up within buffers and dealt by leading words."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held, axis=1)
        rows, weights = added_up(every, np.ones(every.shape[1], dtype=np.int64))
        for dest, own, sums in routed(rows, weights, shared.value, destinations):
            order = np.argsort(dest, kind="stable")
            dest, own, sums = dest[order], own[:, order], sums[order]
            first = run_starts(dest)
            for part in np.array_split(first, len(first) // 64 + 1):
                ends = np.append(first, len(dest))[np.searchsorted(first, part) + 1]
                bodies = [_block(own[:, a:b], sums[a:b]) for a, b in zip(part.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(dest[part], pa.int64()), pa.array(bodies, pa.binary())], names=["dest", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for names, goes_on, *_ in named_words(batch.column(0), batch.column(1).to_pylist(), seed):
                held.append(suffixes(names, goes_on, most_words))
                size += held[-1].shape[1]
                if size >= SUFFIXES:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)

    return docs.select("text", "lang").mapInArrow(run, "dest bigint, body binary")


# --- sorting ------------------------------------------------------------------------------


def partition_sizes(rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffix pointers: depth, one pointer and size of equal partitions of ``least`` or more.

    A partition is a run of ``pointers``; those of a round are split at once.  The order of
    partitions is of no use here and is not kept.
    """
    pointers = np.arange(rows.shape[1])
    lengths = np.array([len(pointers)] if len(pointers) else [], dtype=np.int64)
    depths = np.zeros(len(lengths), dtype=np.int64)
    while len(pointers):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        value = rows[depths[owner], pointers]
        begins = np.cumsum(lengths) - lengths
        pivots = value[begins + lengths // 2]
        pivot = pivots[owner]
        weight = weights[pointers]
        parts = []
        for side, chosen in ((0, value < pivot), (1, value == pivot), (2, value > pivot)):
            at = np.flatnonzero(chosen)
            sizes = np.bincount(owner[at], weights=weight[at], minlength=len(lengths)).astype(np.int64)
            counts = np.bincount(owner[at], minlength=len(lengths))
            stays = sizes >= least
            depth = depths
            if side == 1:
                stays &= pivots > 0  # the phrase goes on
                firsts = at[(np.cumsum(counts) - counts)[stays]]
                for d in np.unique(depths[stays]).tolist():
                    of = depths[stays] == d
                    yield d + 1, pointers[firsts[of]], sizes[stays][of]
                stays &= depths + 1 < len(rows)
                depth = depths + 1
            parts.append((pointers[at[stays[owner[at]]]], counts[stays], depth[stays]))
        pointers, lengths, depths = (np.concatenate(x) for x in zip(*parts))


def _counted(blocks: DataFrame, destinations: int, least: int, most_words: int) -> DataFrame:
    """``words, a``: the phrases of two words or more that occur ``least`` times."""

    def sizes(dest: int, rows: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        level = dest // destinations + 2
        for depth, first, n in partition_sizes(rows, weights, least):
            if depth >= level:
                flat_words = pa.array(np.ascontiguousarray(rows[:depth, first].T).reshape(-1).view(np.int64))
                limits = pa.array(np.arange(len(first) + 1) * depth, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(limits, flat_words), pa.array(n, pa.int64())], names=["words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, limit = None, [], 0, 2 * SUFFIXES
        for batch in batches:
            for dest, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if dest != now:
                    if held:
                        yield from sizes(now, *_together(held))
                    now, held, size, limit = dest, [], 0, 2 * SUFFIXES
                held.append(_unblock(body, most_words))
                size += len(held[-1][1])
                if size > limit:  # as many different suffixes as there are, but not their repeats
                    held = [added_up(*_together(held))]
                    size = len(held[0][1])
                    limit = 2 * max(size, SUFFIXES)
        if held:
            yield from sizes(now, *_together(held))

    partitions = min(MOST_PARTITIONS, destinations)
    placed = blocks.repartition(partitions, "dest").sortWithinPartitions("dest")
    return placed.mapInArrow(run, "words array<bigint>, a bigint")


def _together(held: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([r for r, _ in held], axis=1), np.concatenate([w for _, w in held])


# --- phrases ------------------------------------------------------------------------------


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``words, a, lang, score, l, r``: the cut of least score, the first among equals.

    ``known(words, f, lang)`` counts single words, with their language, and phrases.
    """
    cuts = candidates.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    left = F.slice("words", 1, F.col("k")).alias("left")
    right = F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right")
    cuts = cuts.select("words", "a", "k", left, right)
    cuts = cuts.join(known.select(F.col("words").alias("left"), F.col("f").alias("l"), "lang"), "left")
    cuts = cuts.join(known.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    # Exact beyond 64 bits: decimals of 38 digits hold the products of 16-digit counts.
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide('l')} * {wide('r')})")
    best = cuts.select("words", "a", "lang", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("words", "a").agg(F.min("cut").alias("cut"), F.max("lang").alias("lang"))
    return best.select("words", "a", "lang", "cut.score", "cut.l", "cut.r")


def undominated(candidates: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """The candidates that lie in no longer one of at least ``percent`` of their count."""
    longer = candidates.filter(F.size("words") > 2).select(
        "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    within = longer.select("a", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    around = within.groupBy(F.slice("words", F.col("at"), F.col("size")).alias("words")).agg(F.max("a").alias("around"))
    kept = candidates.join(around, "words", "left")
    return kept.filter(F.coalesce(100 * F.col("around") < percent * F.col("a"), F.lit(True))).drop("around")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP,
                 percent: int = INSIDE_PERCENT, per_destination: int = SUFFIXES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language of ``docs(text, lang)``."""
    spark = docs.sparkSession
    texts = docs.select(as_text().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    vocabulary, seed = _vocabulary(texts)
    per_lang = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    total = per_lang.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], _RESULT)
    destinations = total // per_destination + 1
    hot = vocabulary.filter(F.col("n") > total // min(8 * destinations, MOST_HOT)).select("id").toArrow()
    hot = np.sort(hot.column("id").to_numpy().view(np.uint64))
    blocks = _blocks(texts, seed, hot, destinations, most_words)
    candidates = written(_counted(blocks, destinations, least, most_words), "phrases")
    frequent = vocabulary.filter(F.col("n") >= least)
    known = frequent.select(F.array("id").alias("words"), F.col("n").alias("f"), "lang").unionByName(
        candidates.select("words", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")))
    measured = written(undominated(scored(candidates, known), percent), "scored")
    # All that could be among the first, equal ones too; only their words are spelled out.
    order = [F.col("score").desc(), F.col("a").desc()]
    first = measured.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    spelled = first.select("words", F.posexplode("words").alias("at", "id")).join(frequent.select("id", "word"), "id")
    spelled = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("listed"))
    spelled = spelled.select("words", F.array_join("listed.word", " ").alias("phrase"))
    placed = first.join(spelled, "words").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    return placed.filter(F.col("rank") <= top).join(per_lang, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
