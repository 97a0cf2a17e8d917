"""Language-model scores from a probabilistic suffix tree.

A text is the bytes of its words, lower-cased (A-Z), with a blank behind every word and a
line break at the end; texts are generated byte by byte, each in the state of its longest
context in the tree (``suffix_tree``).  Counts cover all training texts, and all contexts that
pass the tests are kept, however many.

Bytes alone do not remember whole words, so a word's probability is a blend of the tree's
and of its own add-one count, in one of several proportions, and a text's is the even
mixture over these: a score can fall behind the base score by log10 of their number at most.

Neither the tree nor the words of the training texts have a bound, so they do not go to the
texts.  Each block of texts asks once for each of its distinct words, and for each of its distinct
strings of bytes that is not among the frequent ones, which all tasks hold.  Words' counts are summed
by slices of their hashes, strings are answered by slices of the tree, and the answers go back to
the blocks.  Questions and answers travel packed, in one row per block and slice.

Null texts count as empty: no words, one end.  Repeated rows count as often as they occur and
are scored each.  Other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import suffix_tree
from hearsay.llm.packed import chunks, flat, mixed, run_starts
from hearsay.llm.suffix_tree import distinct_grams, grams, normalised
from hearsay.llm.tables import as_text, written

SHARES = (0.0, 0.05, 0.2, 0.5, 0.8)  # of the tree in a word's probability; the rest is the word's count
BLOCK_BYTES = 2 << 20
SLICE_BLOCKS = 32  # blocks for every slice of words
LEAST_SLICES = 32
TASK_BLOCKS = 1  # scored by one task, whatever their compressed size


def blended(base: np.ndarray, tree: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """log10 probability of every text: an even mixture, by text, of the ``SHARES`` of the tree by token."""
    by_share, of_base, of_tree = [], 10.0 ** base, 10.0 ** tree
    for share in SHARES:
        token = base if share == 0 else np.log10((1 - share) * of_base + share * of_tree)
        by_share.append(np.bincount(owner, weights=token, minlength=n))
    totals = np.stack(by_share)
    top = totals.max(0)
    return top + np.log10((10.0 ** (totals - top)).mean(0))


# --- scoring -------------------------------------------------------------------------------


def blocks(docs: DataFrame, key: str) -> DataFrame:
    """``block, keys, held_out, body``: runs of texts in one row each, compressed."""
    kind = dict(docs.dtypes)[key]
    taken = docs.select(F.col(key).alias("key"), F.col("held_out"), as_text().alias("text"))

    def cut(held: list[pa.RecordBatch], last_ones: bool) -> Generator[pa.RecordBatch, None, list[pa.RecordBatch]]:
        """Blocks of all texts held; unless they are the last ones, texts behind a full block are given back."""
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, limits = flat(batch.column(2))
        for first, last, part, ends in chunks(data, limits, BLOCK_BYTES):
            if 0 < first and last == len(batch) and not last_ones:
                return [batch.slice(first)]
            row = {"block": [uuid.uuid4().int & ((1 << 63) - 1)], "keys": [batch.column(0).slice(first, last - first).to_pylist()],
                   "held_out": [batch.column(1).slice(first, last - first).to_pylist()],
                   "limits": [ends.tolist()], "body": [_codec().compress(part.tobytes(), asbytes=True)]}
            yield pa.RecordBatch.from_pydict(row, schema=shape)
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                held = yield from cut(held, False)
        if held:
            yield from cut(held, True)

    arrow_kind = {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string())
    shape = pa.schema([("block", pa.int64()), ("keys", pa.list_(arrow_kind)), ("held_out", pa.list_(pa.bool_())),
                       ("limits", pa.list_(pa.int64())), ("body", pa.binary())])
    return taken.mapInArrow(run, f"block bigint, keys array<{kind}>, held_out array<boolean>, limits array<bigint>, body binary")


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _texts(body: bytes, limits) -> tuple[np.ndarray, np.ndarray]:
    limits = np.asarray(limits, dtype=np.int64)
    return np.frombuffer(_codec().decompress(body, int(limits[-1]), asbytes=True), dtype=np.uint8), limits


def _spaced(data: np.ndarray, limits: np.ndarray) -> list:
    """The texts in parts, as ``suffix_tree.spaced``."""
    return [suffix_tree.spaced(part, ends) for _, _, part, ends in chunks(data, limits)]


def word_names(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that are not empty; no two of the same length up to eight bytes agree, others by a chance of 2^-64."""
    padded = np.zeros(len(text) + 8, dtype=np.uint8)
    padded[:len(text)] = text
    eights = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))

    def pieces(at: np.ndarray, left: np.ndarray, number) -> np.ndarray:
        kept = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        return mixed((eights[at] & kept) ^ mixed(number))

    lengths = ends - begins
    out = pieces(begins, lengths, np.zeros(1, dtype=np.uint64))
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        first = np.cumsum(more) - more
        number = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        own = np.repeat(long, more)
        out[long] += np.add.reduceat(pieces(begins[own] + 8 * number, lengths[own] - 8 * number, number.astype(np.uint64)), first)
    return mixed(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _tokens(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word, lower-cased."""
    hashes, owner, n = [], [], 0
    for text, cuts, (begins, stops) in parts:
        hashes.append(word_names(text, begins, stops - 1))
        owner.append(np.repeat(np.arange(n, n + len(cuts) - 1), np.diff(np.searchsorted(begins, cuts))))
        n += len(cuts) - 1
    return (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _counted(parts: list, held_out: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, their counts in the training texts, and word and text of every token."""
    learned = ~np.asarray(held_out.to_numpy(zero_copy_only=False), dtype=bool)
    hashes, owner = _tokens(parts)
    word, place = np.unique(hashes, return_inverse=True)
    return word, np.bincount(place, weights=learned[owner], minlength=len(word)).astype(np.int64), place, owner


def _asked_words(table: DataFrame, n_slices: int) -> DataFrame:
    """``slice, block, words, counts``: the distinct words of every block and their counts in its training texts, packed."""
    cuts = np.array([(k << 64) // n_slices for k in range(n_slices)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                word, n, _, _ = _counted(_spaced(*_texts(batch.column(2)[i].as_py(), batch.column(3)[i].values)), batch.column(1)[i].values)
                at = np.append(np.searchsorted(word, cuts), len(word))
                filled = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filled, pa.int64()), pa.array(np.full(len(filled), batch.column(0)[i].as_py()), pa.int64()),
                     pa.array([suffix_tree.packed_grams(word[at[k]:at[k + 1]]) for k in filled], pa.binary()),
                     pa.array([suffix_tree.packed_numbers(n[at[k]:at[k + 1]]) for k in filled], pa.binary())],
                    names=["slice", "block", "words", "counts"])

    return table.select("block", "held_out", "body", "limits").mapInArrow(run, "slice bigint, block bigint, words binary, counts binary")


def _counted_words(asked: DataFrame, n_slices: int) -> DataFrame:
    """``slice, block, body, n, v``: how often the words of ``_asked_words`` occur in the training texts of other blocks.

    ``n`` and ``v`` sum up to all training words and the distinct ones.  A task holds the questions to one slice, packed.
    """

    def answer(of: int, asking: list, held: list) -> pa.RecordBatch:
        words, totals = suffix_tree.summed(held)
        bodies = []
        for _, asked_words, counts in asking:
            own = suffix_tree.unpacked_numbers(counts, np.int64)
            bodies.append(suffix_tree.packed_numbers(totals[np.searchsorted(words, suffix_tree.unpacked_grams(asked_words))] - own))
        n, v = (np.zeros(len(asking), np.int64) for _ in range(2))
        n[0], v[0] = totals.sum(), (totals > 0).sum()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(asking), of)), pa.array([block for block, _, _ in asking], pa.int64()),
                                           pa.array(bodies, pa.binary()), pa.array(n), pa.array(v)], names=["slice", "block", "body", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, asking, held, size, least = None, [], [], 0, suffix_tree.HELD_GRAMS
        for batch in batches:
            for part, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if part != of and asking:
                    yield answer(of, asking, held)
                    asking, held, size, least = [], [], 0, suffix_tree.HELD_GRAMS
                of = part
                asking.append(row)
                held.append((suffix_tree.unpacked_grams(row[1]), suffix_tree.unpacked_numbers(row[2], np.int64)))
                size += len(held[-1][0])
                if size > least:  # what is held stays near the number of distinct words
                    held = [suffix_tree.summed(held)]
                    size = len(held[0][0])
                    least = size + max(size, suffix_tree.HELD_GRAMS)
        if asking:
            yield answer(of, asking, held)

    lined = asked.repartition(n_slices, "slice").sortWithinPartitions("slice")
    return lined.mapInArrow(run, "slice bigint, block bigint, body binary, n bigint, v bigint")


def _asked_grams(table: DataFrame, tree: suffix_tree.Tree, often: Broadcast) -> DataFrame:
    """``block, slice, body``: the distinct strings of every block that are not frequent, by the slice that answers them."""
    depth, n_slices = tree.depth, tree.n_slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data, limits = _texts(batch.column(1)[i].as_py(), batch.column(2)[i].values)
                found = distinct_grams(_normalised(data, limits), depth)
                found = found[~suffix_tree.places(often.value[0], found)[0]]
                at = suffix_tree.slice_limits(found, n_slices)
                filled = np.flatnonzero(np.diff(at))
                bodies = [suffix_tree.packed_grams(found[at[k]:at[k + 1]]) for k in filled]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(filled), batch.column(0)[i].as_py()), pa.int64()),
                                                  pa.array(filled, pa.int64()), pa.array(bodies, pa.binary())], names=["block", "slice", "body"])

    return table.select("block", "body", "limits").mapInArrow(run, "block bigint, slice bigint, body binary")


def _normalised(data: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, part, ends in chunks(data, limits):
        yield normalised(part, ends)[:2]


def tree_scores(parts: list, depth: int, often: tuple, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every word, its blank included, and of every text's end.

    ``answers`` are those to the texts' ``distinct_grams`` that are not among the ``often`` ones, in their order.
    """
    every = [suffix_tree.turned(grams(suffix_tree.nonzero(text), cuts, depth + 1)) for text, cuts, _ in parts]
    wanted = np.concatenate(every)
    order, lined = suffix_tree.line(wanted)
    first = run_starts(lined)
    asked = lined[first]
    hit, at = suffix_tree.places(often[0], asked)
    values = np.empty(len(asked))
    values[hit], values[~hit] = often[1][at], answers
    found = np.empty(len(wanted))
    found[order] = np.repeat(values, np.diff(np.append(first, len(lined))))
    of_words, of_ends, begun = [], [], 0
    for (_, cuts, (begins, stops)), own in zip(parts, every):
        sums = np.concatenate(([0.0], np.cumsum(found[begun:begun + len(own)])))
        of_words.append(sums[stops] - sums[begins])
        of_ends.append(found[begun + cuts[1:] - 1])
        begun += len(own)
    return np.concatenate(of_words), np.concatenate(of_ends)


def score(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, tree_score`` of ``docs(key, text, held_out)``.

    The texts that are not held out are learned from.  ``tree_score`` is the tree's alone.
    """
    kind = dict(docs.dtypes)[key]
    tree = suffix_tree.fit(docs.filter(~F.col("held_out")).select(as_text().alias("text")), **options)
    depth = tree.depth
    table = written(blocks(docs, key), "blocks")
    # Dealt into a stated number of partitions, which are not merged by their compressed size.
    n_blocks = table.count()
    parts, n_slices = n_blocks // TASK_BLOCKS + 1, LEAST_SLICES + n_blocks // SLICE_BLOCKS
    answers = written(_counted_words(_asked_words(table, n_slices), n_slices), "answers")
    known, kinds = answers.agg(F.sum("n"), F.sum("v")).first()
    ends = docs.agg(F.count_if(~F.col("held_out"))).first()[0]
    tokens, vocabulary = int(known or 0) + int(ends), int(kinds or 0) + (1 if ends else 0)
    often = docs.sparkSession.sparkContext.broadcast(tree.often)

    def by_block(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("block", "slice", "body").repartition(parts, "block").groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("slice", F.col("body").alias("value")))).alias(name))

    lists = by_block(answers, "counts")
    priced = by_block(suffix_tree.answered(_asked_grams(table, tree, often), tree), "values")

    def answered(column: pa.ListArray, i: int, kind) -> np.ndarray:
        rows = column[i].values
        bodies = rows.field(1).to_pylist() if rows is not None else []
        return np.concatenate([np.zeros(0, kind), *(suffix_tree.unpacked_numbers(body, kind) for body in bodies)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(tokens + vocabulary + 1)
        end = np.log10(ends + 1) - scale
        for batch in batches:
            for i in range(len(batch)):
                data, limits = _texts(batch.column(2)[i].as_py(), batch.column(3)[i].values)
                n = len(limits) - 1
                texts = _spaced(data, limits)
                _, own, place, owner = _counted(texts, batch.column(1)[i].values)
                count = own + answered(batch.column(4), i, np.int64)
                plain, seen = (np.log10(count + 1) - scale)[place], (count > 0)[place]
                base = np.bincount(owner, weights=plain, minlength=n) + end
                known_words = np.bincount(owner, weights=seen, minlength=n).astype(np.int64) + (1 if ends else 0)
                tree_words, tree_ends = tree_scores(texts, depth, often.value, answered(batch.column(5), i, np.float32))
                alone = np.bincount(owner, weights=tree_words, minlength=n) + tree_ends
                value = blended(np.concatenate([plain, np.full(n, end)]), np.concatenate([tree_words, tree_ends]),
                                np.concatenate([owner, np.arange(n)]), n)
                keys = batch.column(0)[i].values
                yield pa.RecordBatch.from_arrays([
                    keys, batch.column(1)[i].values, pa.array(np.bincount(owner, minlength=n) + 1, pa.int64()), pa.array(known_words),
                    pa.array(np.full(n, tokens, dtype=np.int64)), pa.array(base), pa.array(value), pa.array(alone)],
                    names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "tree_score"])

    joined = table.repartition(parts, "block").join(lists, "block", "left").join(priced, "block", "left").select(
        "keys", "held_out", "body", "limits", "counts", "values")
    return joined.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                  "base_score double, score double, tree_score double")
