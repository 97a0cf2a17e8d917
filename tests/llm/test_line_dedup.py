import collections
import random

import numpy as np
import pytest

from hearsay.llm import line_dedup
from hearsay.llm.line_dedup import CuckooFilter


def _plain(rows, indexed, least):
    """Key, lines, dropped lines and kept text of every row, from a plain count."""
    keys = lambda text: [line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
                         for line in (text or "").split("\n")]
    counts = collections.Counter(k for _, text in indexed for k in set(keys(text)) if k)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line, k in zip(lines, keys(text)) if counts[k] < least]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def _some_rows(n, seed):
    draw = random.Random(seed)
    lines = ["Menu", " menu\t", "HOME | about", "É lan", "é lan", "", "  ", "x" * 3000, "end\r", "a b"]
    make = lambda: "\n".join(draw.choice(lines) if draw.random() < 0.4 else f"line {draw.randrange(400)}"
                             for _ in range(draw.randrange(1, 12)))
    return [(i, make()) for i in range(n)]


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 0])
def test_lines_match_a_plain_count(spark, odd_docs, odd_rows, filter_bytes):
    rows = _some_rows(300, 1) + [(None, "Menu\nmenu"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING").repartition(3)
    index = line_dedup.build(docs, least=5, shard_keys=40)
    assert index.bits > 2
    assert _got(line_dedup.clean(docs, index, filter_bytes=filter_bytes)) == _plain(rows, rows, 5)
    odd = [(r[0], r[1]) for r in odd_rows]
    assert _got(line_dedup.clean(odd_docs, line_dedup.build(odd_docs, least=2), filter_bytes=filter_bytes)) == _plain(odd, odd, 2)


def test_insertions_and_deletions_are_reversible(spark):
    first, second, third = _some_rows(120, 2), _some_rows(400, 3), _some_rows(30, 4)
    frames = [spark.createDataFrame(rows, "doc_id INT, text STRING") for rows in (first, second, third)]
    start = line_dedup.build(frames[0], least=4, shard_keys=100)
    grown = line_dedup.insert(line_dedup.insert(start, frames[2], shard_keys=100), frames[1], shard_keys=100)
    assert grown.bits > start.bits  # shards were split
    everything = first + second + third
    assert _got(line_dedup.clean(frames[0], grown)) == _plain(first, everything, 4)
    back = line_dedup.delete(line_dedup.delete(grown, frames[1]), frames[2])
    assert _got(back.counts.select("high", "low", "n")) == _got(start.counts)
    for filter_bytes in (line_dedup.FILTER_BYTES, 0):
        assert _got(line_dedup.clean(frames[0], back, filter_bytes=filter_bytes)) == _plain(first, first, 4)
    half = line_dedup.delete(start, spark.createDataFrame(first[::2], "doc_id INT, text STRING"))
    assert _got(line_dedup.clean(frames[0].filter("doc_id % 2 = 1"), half)) == _plain(first[1::2], first[1::2], 4)
    empty = line_dedup.delete(start, frames[0])
    assert empty.counts.isEmpty()
    with pytest.raises(ValueError):
        line_dedup.delete(empty, frames[2])


def test_cuckoo_filter_against_a_set():
    draw = np.random.default_rng(5)
    for n in (0, 1, 7, 5_000):
        hashes = np.unique(draw.integers(0, 1 << 63, 2 * n + 10, dtype=np.uint64))
        draw.shuffle(hashes)
        inside, outside = hashes[:n], hashes[n:]
        made = CuckooFilter.of(inside)
        assert made.has(inside).all() and made.has(outside).mean() < 0.01
        made.delete(inside[: n // 2])
        assert made.has(inside[n // 2:]).all() and np.count_nonzero(made.slots) == n - n // 2
        assert CuckooFilter.read(made.write()).has(inside[n // 2:]).all()
        if n > 1:
            with pytest.raises(ValueError):
                made.delete(outside)


def test_keys_with_one_fingerprint_are_corrected(spark):
    """Every key that a filter lets through by mistake is listed with it."""
    n = 60_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('often ', id % 3000, '\\nrare ', id) AS text")
    index = line_dedup.build(docs)
    assert sum(len(r.mistaken) for r in index.filters.collect()) > 0
    found = line_dedup.clean(docs, index)
    assert found.filter("n_lines <> 2 OR n_dropped <> 1 OR kept <> concat('rare ', doc_id)").count() == 0


def test_lines_of_no_rows(no_docs):
    assert line_dedup.clean(no_docs, line_dedup.build(no_docs)).count() == 0
