import collections
import random
import re

import numpy as np
import pytest

from hearsay.llm import phrases


def _plain(rows, most_words=3, least=10, top=2000, percent=50):
    """All counts of ``rows(text, lang)`` in dictionaries, with Python's whole numbers."""
    counts, sizes = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            found = re.findall("[^ \t]+", piece)
            sizes[lang] += len(found)
            counts.update((lang, tuple(found[i:i + m])) for m in range(1, most_words + 1) for i in range(len(found) - m + 1))
    listed = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    around = collections.Counter()
    for (lang, words), a in listed.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                around[lang, words[i:i + m]] = max(around[lang, words[i:i + m]], a)
    out = collections.defaultdict(list)
    for (lang, words), a in listed.items():
        if around[lang, words] and 100 * around[lang, words] >= percent * a:
            continue
        cuts = [(10 ** 6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -score)
            for lang in sorted(out) for i, (score, a, p, l, r) in enumerate(sorted(out[lang])[:top])]


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def _rows(n, seed, hot=0.3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "the", "The", "new york", "a  b"]
    say = lambda: "the the" if draw.random() < hot else draw.choice(vocabulary)
    return [(draw.choice([" ", "\t", ", ", ". "]).join(say() for _ in range(draw.randrange(30))), draw.choice(["en", "de", None]))
            for _ in range(n)]


@pytest.mark.parametrize(("options", "per_destination"), [
    ({}, 1 << 20), ({"least": 3, "top": 7, "percent": 90}, 200), ({"most_words": 4, "least": 4}, 200), ({"most_words": 2}, 200)])
def test_phrases_match_plain_counts(spark, options, per_destination):
    rows = _rows(300, 1) + [(None, "en"), ("", None), ("one", "fr"), ("x " * 3000, "fr")]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING").repartition(4)
    assert _got(phrases.collocations(docs, per_destination=per_destination, **options)) == _plain(rows, **options)


def test_phrases_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert _got(phrases.collocations(odd_docs, least=2)) == _plain([(r[1], r[2]) for r in odd_rows], least=2)
    assert phrases.collocations(no_docs).count() == 0


def test_equal_partitions_are_counts():
    draw = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        rows = draw.integers(1, 9, (3, n)).astype(np.uint64) ** np.uint64(9)
        rows[2, draw.random(n) < 0.2] = 0
        weights = draw.integers(1, 4, n)
        counts = collections.Counter()
        for column, w in zip(rows.T.tolist(), weights.tolist()):
            for d in (1, 2, 3):
                if column[d - 1]:
                    counts[tuple(column[:d])] += w
        found = {}
        for depth, first, size in phrases.partition_sizes(rows, weights, 6):
            found.update({tuple(rows[:depth, i].tolist()): s for i, s in zip(first.tolist(), size.tolist())})
        assert found == {k: v for k, v in counts.items() if v >= 6}


def test_hot_words_are_spread_over_destinations():
    """Where two hot words lead nearly all suffixes, no destination gets a large part."""
    draw = np.random.default_rng(4)
    n = 40_000
    rows = np.stack([np.full(n, 7), np.full(n, 9), draw.integers(100, 30_000, n)]).astype(np.uint64)
    rows, weights = phrases.added_up(rows, np.ones(n, dtype=np.int64))
    parts = list(phrases.routed(rows, weights, np.array([7, 9], dtype=np.uint64), 50))
    dest = np.concatenate([d for d, _, _ in parts])
    assert np.bincount(dest).max() < 2 * rows.shape[1] / 50
    pair = [(r[:, 0].tolist(), w.tolist()) for d, r, w in parts if len(d) == 1]
    assert pair == [([7, 9, 0], [n])]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_019
    known = spark.createDataFrame([([1], big, "en"), ([2], big + 1, "en"), ([1, 2], big - 1, None)], "words array<bigint>, f bigint, lang string")
    found = phrases.scored(known.filter("size(words) = 2").selectExpr("words", "f AS a"), known).first()
    assert found.score == 10 ** 6 * (big - 1) ** 2 // (big * (big + 1)) and (found.l, found.r, found.lang) == (big, big + 1, "en")
