"""Texts of a few words: alone in a table, and between very long ones; and hashes of byte ranges."""

import numpy as np
import pyarrow as pa
import pytest

from hearsay.llm import fingerprints, near_dedup
from hearsay.llm.packed import Hasher, flat, shingles, word_hashes

LONG = " ".join(f"w{i}" for i in range(160_000))


@pytest.mark.parametrize("n", range(7))
def test_shingles_of_few_words(n):
    text = " ".join("abcdefg"[:n])
    for texts in ([text], [LONG, text, LONG], [text, "", text]):
        hashes, owner = word_hashes(*flat(pa.array(texts)))
        found, of = shingles(hashes, owner, 5)
        assert np.bincount(of, minlength=len(texts))[texts.index(text)] == (0 if n == 0 else max(1, n - 4))


@pytest.mark.parametrize("n", range(7))
def test_operators_on_one_short_row(spark, n):
    docs = spark.createDataFrame([(1, " ".join("abcdefg"[:n]))], "doc_id BIGINT, text STRING")
    assert [tuple(r) for r in near_dedup.classes(docs).collect()] == [(1, 1, 1)]
    assert near_dedup.dedup(docs).count() == 1
    assert [r.near_next for r in fingerprints.compare_with_next(docs).collect()] == [1.0]


def test_short_rows_between_long_ones(spark):
    texts = [LONG, "one two three", LONG + " end", "one two", "one two three", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(1)
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert classes == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1, 5: 5}


def test_hashes_of_mirrored_words_differ():
    word = [0]
    for _ in range(14):
        word += [1 - b for b in word]
    ab, ba = (np.array([97 + (b ^ flip) for b in word], dtype=np.uint8) for flip in (0, 1))
    n = len(word)
    a, b, again = Hasher(np.concatenate([ab, ba, ab])).ranges(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert a == again != b
    assert Hasher(ab, seed=1).ranges(np.array([0]), np.array([n]))[0] != a


def test_columns_of_any_name_stay(spark):
    schema = "doc_id BIGINT, text STRING, k INT, m INT, drop INT, rows INT, own INT, mark INT, row INT, key INT"
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text, *range(8)), (2, text, *range(8)), (1, text, *range(8)), (3, "other words", *range(8))]
    kept = near_dedup.dedup(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
