"""A probabilistic suffix tree over bytes, held in slices.

The tree holds byte contexts of up to ``DEPTH`` bytes.  A context is retained if it is
frequent and its next-byte distribution diverges enough from that of the context one byte
shorter (log-likelihood gain per parameter), and with it all its suffixes; contexts of up to
one byte always are.  Distributions are smoothed by blending every one with that of the next
shorter state (Witten-Bell), down to a uniform one.  A byte is scored in the state of its
longest retained context.

Contexts that agree in their last two bytes have all their suffixes of two bytes or more in
common reach, so a tree falls into slices by these two bytes.  A slice is grown in one task
from its part of the summed counts; no number of contexts is dropped, and nothing of the
tree passes the driver but the counts after single bytes (65,536 numbers at most).  The
number of slices grows with the texts.  A pair of bytes is in one slice, whose size is that of
the distinct strings that end in this pair and a byte.  Strings travel packed: in an order
where neighbours are in the same state, and compressed.

Strings that the training texts hold once in ``OFTEN_BYTES`` or more often are at most about
as many as these bytes, however large the texts.  Their probabilities are taken from
the slices and held by all tasks; only other strings are asked for.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.packed import LOWER, chunks, flat, run_starts
from hearsay.llm.tables import written

DEPTH = 6
LEAST_COUNT = 10
LEAST_GAIN = 1.0  # log-likelihood per next byte seen
SLICE_BYTES = 4 << 20  # of text for every slice
LEAST_SLICES = 32
HELD_GRAMS = 3_000_000
SORTED_GRAMS = 8 << 20  # of texts, at once
PIECE_GRAMS = 1 << 15  # worked on at once, so that what is between two steps stays in a core's cache
ASKED_GRAMS = 1 << 19  # answered at once
PAIRS = -1
OFTEN_BYTES = 4 << 20
BLANK, END = 32, 10
_SPREAD = 40503
_PLAIN = LOWER.copy()
_PLAIN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK


# --- texts as byte sequences -------------------------------------------------------------


def spaced(data: np.ndarray, limits: np.ndarray):
    """Bytes with a blank behind every word and an end behind every text; texts' limits, words' limits."""
    n = len(limits) - 1
    # Two blanks behind every text: one for its last word, one for its end.
    ends = limits[1:] + 2 * np.arange(n) + 1
    real = np.ones(len(data) + 2 * n, dtype=bool)
    real[ends - 1] = real[ends] = False
    text = np.full(len(real), BLANK, dtype=np.uint8)
    text[real] = _PLAIN[data]
    inside = text != BLANK
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    kept[ends] = True
    text[ends] = END
    out = text[kept]
    cuts = np.concatenate(([0], np.flatnonzero(out == END) + 1))
    blank = out == BLANK
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[cuts[:-1]] = True
    begins[cuts[1:] - 1] = False
    return out, cuts, (np.flatnonzero(begins), np.flatnonzero(blank) + 1)


def nonzero(text: np.ndarray) -> np.ndarray:
    """Bytes of which none is 0: a context's number must tell its length."""
    return np.maximum(text, 1)


def normalised(data: np.ndarray, limits: np.ndarray):
    """``spaced`` as a tree reads it, without 0."""
    text, cuts, of_words = spaced(data, limits)
    return nonzero(text), cuts, of_words


def grams(text: np.ndarray, cuts: np.ndarray, size: int) -> np.ndarray:
    """Every byte with the ``size - 1`` bytes before it in one number; an end stands before a text."""
    n = len(cuts) - 1
    before = (cuts[:-1] + size * np.arange(n))[:, None] + np.arange(size)
    real = np.ones(len(text) + size * n, dtype=bool)
    real[before] = False
    padded = np.zeros(7 + len(real), dtype=np.uint8)
    padded[7:][before[:, -1]] = END
    padded[7:][real] = text
    # Eight bytes from every place on, the last one lowest.
    out = np.ndarray(len(real), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)[real]
    out &= np.uint64((1 << 8 * size) - 1)
    return out


def _by_pieces(function, values: np.ndarray) -> np.ndarray:
    """``function`` of every value."""
    if len(values) <= PIECE_GRAMS:
        return function(values)
    return np.concatenate([function(values[k:k + PIECE_GRAMS]) for k in range(0, len(values), PIECE_GRAMS)])


def _low(values: np.ndarray, size: int) -> np.ndarray:
    return values & np.uint64((1 << 8 * size) - 1)


# --- growing -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """``slices(slice, body, often)``; ``root[a, b]`` is the smoothed probability of byte b after byte a.

    ``often``: the frequent grams, turned and sorted, and the log10 probabilities of their last bytes.
    """

    depth: int
    root: np.ndarray
    slices: DataFrame
    n_slices: int
    often: tuple[np.ndarray, np.ndarray]


def gram_counts(docs: DataFrame, depth: int, n_slices: int) -> DataFrame:
    """``slice, body``: packed grams of ``docs(text)``, a byte and ``depth`` bytes before it, with counts, of parts of the texts.

    Rows of slice ``PAIRS`` hold the counts of two bytes.
    """

    def rows(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ending = run_starts(values >> np.uint64(40))  # of one pair in the context and one last byte
        pairs = np.bincount(_low(_straight(values[ending]), 2).astype(np.int64), weights=np.add.reduceat(counts, ending)).astype(np.int64)
        pair = np.flatnonzero(pairs)
        at = slice_limits(values, n_slices)
        filled = np.flatnonzero(np.diff(at))
        bodies = [pickle.dumps((packed_grams(values[at[k]:at[k + 1]]), packed_numbers(counts[at[k]:at[k + 1]])))
                  for k in filled]
        return pa.RecordBatch.from_arrays([pa.array([PAIRS, *filled.tolist()], pa.int64()), pa.array(
            [pickle.dumps((pair, pairs[pair])), *bodies], pa.binary())], names=["slice", "body"])

    def counted(found: list) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(found)
        values.sort()
        first = run_starts(values)
        return values[first], np.diff(np.append(first, len(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, held = [], 0, []
        for batch in batches:
            data, limits = flat(batch.column(0))
            for _, _, part, ends in chunks(data, limits):
                text, cuts, _ = normalised(part, ends)
                found.append(turned(grams(text, cuts, depth + 1)))
                size += len(text)
                if size >= SORTED_GRAMS:
                    held.append(counted(found))
                    found, size = [], 0
                    held = [summed(held)] if len(held) > 1 else held
                    if len(held[0][0]) > HELD_GRAMS // 2:
                        yield rows(*held.pop())
        if found:
            held.append(counted(found))
        if held:
            yield rows(*(summed(held) if len(held) > 1 else held[0]))

    return docs.select("text").mapInArrow(run, "slice bigint, body binary")


def _pair_counts(counted: DataFrame) -> np.ndarray:
    """How often byte b follows byte a in the texts, by a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                pair, n = pickle.loads(body)
                total[pair] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    found = counted.filter(F.col("slice") == PAIRS).select("body").mapInArrow(run, "pair bigint, n bigint")
    rows = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    out = np.zeros(1 << 16)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(256, 256)


def summed(held) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the sums of their counts."""
    values = np.concatenate([v for v, _ in held])
    counts = np.concatenate([n for _, n in held])
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    first = run_starts(values)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def turned(values: np.ndarray) -> np.ndarray:
    """Grams as numbers that sort by slice and, within, so that those of one state and byte are close.

    Their bytes from high to low: the last two of the context, scrambled; the gram's last one;
    the rest of the context from near to far.
    """
    return _by_pieces(_turned, values)


def _turned(values: np.ndarray) -> np.ndarray:
    pair = (values >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((pair * np.uint64(_SPREAD) & np.uint64(0xFFFF)) << np.uint64(48) | (values & np.uint64(255)) << np.uint64(40)
            | (values >> np.uint64(24)).byteswap() >> np.uint64(24))


def _straight(values: np.ndarray) -> np.ndarray:
    """The grams that were ``turned``."""
    return _by_pieces(_turned_back, values)


def _turned_back(values: np.ndarray) -> np.ndarray:
    pair = (values >> np.uint64(48)) * np.uint64(pow(_SPREAD, -1, 1 << 16)) & np.uint64(0xFFFF)
    rest = ((values & np.uint64((1 << 40) - 1)) << np.uint64(24)).byteswap()
    return rest << np.uint64(24) | pair << np.uint64(8) | values >> np.uint64(40) & np.uint64(255)


def slice_limits(values: np.ndarray, n_slices: int) -> np.ndarray:
    """The limits of the slices in sorted turned grams."""
    first = -(-(np.arange(n_slices, dtype=np.int64) << 16) // n_slices)
    return np.append(np.searchsorted(values, first.astype(np.uint64) << np.uint64(48)), len(values))


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers of a fixed size, compressed, and how many: their first bytes, then their second ones and so on."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked_numbers(body: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(body[:4], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(body[4:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(kind).ravel()


def packed_grams(values: np.ndarray) -> bytes:
    """Sorted turned grams, or other sorted 64-bit values, as compressed differences."""
    return packed_numbers(np.diff(values, prepend=np.uint64(0)))


def unpacked_grams(body: bytes) -> np.ndarray:
    return np.cumsum(unpacked_numbers(body, np.uint64), dtype=np.uint64)


def first_order(after_one: np.ndarray) -> np.ndarray:
    """Smoothed probabilities after one byte, from ``after_one[a, b]``, the count of b after a."""
    after_none = after_one.sum(0)
    share = np.full(256, 1 / 256)
    for counts in (after_none[None, :], after_one):
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        share = np.where(total > 0, (counts + kinds * share) / np.maximum(total + kinds, 1), share)
    return share


def grown(gram: np.ndarray, n: np.ndarray, after_one: np.ndarray, depth: int, least_count: int, least_gain: float) -> list:
    """Per length from 2: retained contexts, their totals and kinds of next bytes; their grams and counts."""
    levels = {depth: summed([(gram, n)])}
    for d in range(depth - 1, 1, -1):
        values, counts = levels[d + 1]
        levels[d] = summed([(_low(values, d + 1), counts)])
    out, kept = [], np.zeros(0, np.uint64)
    for d in range(depth, 1, -1):
        values, counts = levels[d]
        context = values >> np.uint64(8)
        starts = run_starts(context)
        total, kinds = np.add.reduceat(counts, starts), np.diff(np.append(starts, len(values)))
        low = _low(values, d)
        if d == 2:
            one = (low >> np.uint64(8)).astype(np.int64)
            before = after_one[one, (low & np.uint64(255)).astype(np.int64)] / after_one.sum(1)[one]
        else:
            shorter, m = levels[d - 1]
            runs = run_starts(shorter >> np.uint64(8))
            mass = np.repeat(np.add.reduceat(m, runs), np.diff(np.append(runs, len(shorter))))
            at = np.searchsorted(shorter, low)
            before = m[at] / mass[at]
        gain = np.add.reduceat(counts * np.log(counts / np.repeat(total, kinds) / before), starts)
        own = context[starts]
        # A context whose first byte is missing (0) reaches before the text: it has no place in the tree.
        good = (total >= least_count) & (gain >= least_gain * kinds) & (own >> np.uint64(8 * (d - 1)) > 0)
        good |= np.isin(own, _low(kept, d))
        kept, rows = own[good], np.repeat(good, kinds)
        out.append((kept, total[good], kinds[good], values[rows], counts[rows]))
    return out[::-1]


def fit(docs: DataFrame, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> Tree:
    """The tree of all texts of ``docs(text)``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = min(1 << 16, LEAST_SLICES + size // SLICE_BYTES)
    counted = written(gram_counts(docs, depth, n_slices), "grams")
    after_one = _pair_counts(counted)
    root = first_order(after_one)
    shared = docs.sparkSession.sparkContext.broadcast((after_one, root))
    least_often = max(1, -(-size // OFTEN_BYTES))

    def grow(of: int, held: list) -> pa.RecordBatch:
        values, counts = summed(held)
        after, first = shared.value
        levels = grown(_straight(values), counts, after, depth, least_count, least_gain)
        often = values[counts >= least_often]
        priced = pickle.dumps((packed_grams(often), packed_numbers(log_probabilities(levels, first, often)))) if len(often) else None
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([zlib.compress(pickle.dumps(levels), 1)], pa.binary()),
                                           pa.array([priced], pa.binary())], names=["slice", "body", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, least = None, [], 0, HELD_GRAMS
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != of and held:
                    yield grow(of, held)
                    held, size, least = [], 0, HELD_GRAMS
                of = part
                values, counts = pickle.loads(batch.column(1)[i].as_py())
                held.append((unpacked_grams(values), unpacked_numbers(counts, np.int64)))
                size += len(held[-1][0])
                if size > least:  # what is held stays near the number of distinct grams
                    held = [summed(held)]
                    size = len(held[0][0])
                    least = size + max(size, HELD_GRAMS)
        if held:
            yield grow(of, held)

    lined = counted.filter(F.col("slice") != PAIRS).repartition(n_slices, "slice").sortWithinPartitions("slice")
    slices = written(lined.mapInArrow(run, "slice bigint, body binary, often binary"), "slices")
    return Tree(depth, root, slices, n_slices, _often(slices))


def _often(slices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    held = [pickle.loads(body) for body in slices.filter("often IS NOT NULL").select("often").toArrow().column(0).to_pylist()]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    values = np.concatenate([unpacked_grams(body) for body, _ in held])
    order = np.argsort(values)
    return values[order], np.concatenate([unpacked_numbers(body, np.float32) for _, body in held])[order]


# --- asking ------------------------------------------------------------------------------


def probabilities(levels: list, root: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Probability of the last byte of every gram in the state of its longest retained context."""
    context = asked >> np.uint64(8)
    p = root[(context & np.uint64(255)).astype(np.int64), (asked & np.uint64(255)).astype(np.int64)]
    left = np.arange(len(asked))  # with a context all its suffixes are retained: only what has the shorter one can have a longer one
    for d, (own, total, kinds, values, counts) in enumerate(levels, 2):
        if not len(own) or not len(left):
            break
        sought = _low(context[left], d)
        at = np.minimum(np.searchsorted(own, sought), len(own) - 1)
        hit = own[at] == sought
        left, at = left[hit], at[hit]
        gram = _low(asked[left], d + 1)
        there = np.minimum(np.searchsorted(values, gram), len(values) - 1)
        n = np.where(values[there] == gram, counts[there], 0)
        p[left] = (n + kinds[at] * p[left]) / (total[at] + kinds[at])
    return p


def log_probabilities(levels: list, root: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """log10 probabilities (32-bit) of turned grams."""
    return _by_pieces(lambda some: np.log10(probabilities(levels, root, _turned_back(some))).astype(np.float32), asked)


def places(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` are among the sorted ``values``, and where these are."""
    if not len(values):
        return np.zeros(len(asked), dtype=bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    hit = values[at] == asked
    return hit, at[hit]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[run_starts(values)]


def distinct_grams(texts: Iterator[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """The distinct grams of the texts, turned and sorted."""
    held = [turned(grams(text, cuts, depth + 1)) for text, cuts in texts]
    return _distinct(np.concatenate(held)) if held else np.zeros(0, np.uint64)


def line(values: np.ndarray, free: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers whose lowest ``free`` bits are 0, as those of turned grams, and the numbers in this order.

    The free bits hold places where they suffice; if not, numbers are lined up by their highest byte, which is then free as well.
    """
    if len(values) <= 1 << free:
        placed = values | np.arange(len(values), dtype=np.uint64)
        placed.sort()
        place = placed & np.uint64((1 << free) - 1)
        placed ^= place
        return place.astype(np.int64), placed
    first = (values >> np.uint64(56)).astype(np.uint8)
    order = np.argsort(first, kind="stable")
    lined = values[order]
    lined <<= np.uint64(8)
    at = np.append(0, np.cumsum(np.bincount(first, minlength=256)))
    for k in np.flatnonzero(np.diff(at)):
        part = slice(at[k], at[k + 1])
        place, some = line(lined[part], free + 8)
        order[part] = order[part][place]
        some >>= np.uint64(8)
        some |= np.uint64(int(k) << 56)
        lined[part] = some
    return order, lined


def answered(asked: DataFrame, tree: Tree) -> DataFrame:
    """``block, slice, body``: log10 probabilities (32-bit, packed) for ``asked(block, slice, body)``, packed grams.

    A task reads a slice of the tree, then the questions to it, about ``ASKED_GRAMS`` grams at once, of which equal ones
    are answered once: it holds one slice and so many questions, however many blocks ask.
    """
    model = tree.slices.select("slice", F.lit(None).cast("bigint").alias("block"), "body")
    lined = model.unionByName(asked.select("slice", "block", "body")).repartition(tree.n_slices, "slice").sortWithinPartitions(
        "slice", F.col("block").asc_nulls_first())
    root = asked.sparkSession.sparkContext.broadcast(tree.root)

    def answer(levels: list, of: int, asking: list) -> pa.RecordBatch:
        order, lined = line(np.concatenate([sought for _, sought in asking]))
        first = run_starts(lined)
        p = np.empty(len(lined), dtype=np.float32)
        p[order] = np.repeat(log_probabilities(levels, root.value, lined[first]), np.diff(np.append(first, len(lined))))
        at = np.cumsum([0, *(len(sought) for _, sought in asking)])
        return pa.RecordBatch.from_arrays([pa.array([block for block, _ in asking], pa.int64()), pa.array(np.full(len(asking), of), pa.int64()),
                                           pa.array([packed_numbers(p[a:b]) for a, b in zip(at, at[1:])], pa.binary())],
                                          names=["block", "slice", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, of, asking, size = [], None, [], 0
        for batch in batches:
            for i, (part, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if asking and (part != of or size >= ASKED_GRAMS):
                    yield answer(levels, of, asking)
                    asking, size = [], 0
                body = batch.column(2)[i].as_py()
                if part != of:
                    levels, of = [], part
                if block is None:
                    levels = pickle.loads(zlib.decompress(body))
                else:
                    asking.append((block, unpacked_grams(body)))
                    size += len(asking[-1][1])
        if asking:
            yield answer(levels, of, asking)

    return lined.select("slice", "block", "body").mapInArrow(run, "block bigint, slice bigint, body binary")
