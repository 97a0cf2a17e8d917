import collections
import random
import re
import zlib

import pytest

from hearsay.llm import spelling


def _plain_words(rows, rate=97):
    counts = collections.Counter()
    for key, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if key is None else key}:{found}".encode())
            if rate and h % rate == 0:
                at = h % len(found)
                found = found[:at] + found[at + 1:]
            if len(found) >= 5:
                counts[found] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def _plain(words):
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    form, near = {}, {}
    for w, n in words.items():
        found = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if _one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, near[w], words[form[w]] if form[w] else 0) for w, n in words.items())


def _got(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def _rows(n, seed):
    """Texts of a few words, many of them misspelt somewhere."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeàÿ") for _ in range(draw.randrange(4, 9))) for _ in range(60)]

    def say():
        word = draw.choice(stems[:1 + int(60 * draw.random() ** 3)])
        at = draw.randrange(len(word))
        kind = draw.random()
        if kind < 0.1:
            return word[:at] + word[at + 1:]
        if kind < 0.2:
            return word[:at] + draw.choice("abÀÿ") + word[at:]
        return word[:at] + draw.choice("abcÿ") + word[at + 1:] if kind < 0.3 else word.upper() if kind < 0.4 else word

    return [(i, draw.choice([" ", "-", "1"]).join(say() for _ in range(draw.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 16])
def test_variants_match_all_pairs(spark, chunk):
    rows = _rows(300, 1) + [(None, "Ünter ünter Ünter"), (None, None), (1, ""), (2, "x" * 2000 + " "), (3, ("y" * 300 + " ") * 4), (3, ("y" * 301 + " ") * 9)]
    rows += [(4, f"{a}{b}cdef {a}{b}cdef {a}{b}cdef") for a in "abcdefghijklmnop" for b in "abcdefgh"]
    rows += [(9, "kettlesxy " * 3 + "kettlesx " * 6 + "kettles " * 14 + "kettle " * 30 + "kettler " * 30)]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING").repartition(3)
    expected = _plain(_plain_words(rows))
    assert len(expected) > 300 and len({r for _, f, r, *_ in expected if f and r != f}) > 0
    assert _got(spelling.variants(docs, chunk=chunk)) == expected


def test_variants_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert _got(spelling.variants(odd_docs)) == _plain(_plain_words([(r[0], r[1]) for r in odd_rows]))
    assert spelling.variants(no_docs).count() == 0


def test_bitsets_find_every_edit():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 7))) for _ in range(400)})
    index = spelling.PositionIndex(words)
    i, j = index.near(words[:150])
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(150) for b in range(len(words)) if _one_edit(words[a], words[b])]


def test_damage_follows_the_hash():
    rows = [(7, f"wordnumber{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    changed = [w for k, w in rows if spelling.damaged(str(k), w) != w]
    assert 0 < len(changed) < 30 and all(zlib.crc32(f"7:{w}".encode()) % 97 == 0 for w in changed)


def test_large_blocks_are_cut(spark):
    words = spark.range(3000).selectExpr("concat('abcde', lpad(conv(id, 10, 26), 3, '0')) AS word", "id + 3 AS n")
    words = words.selectExpr("translate(word, '0123456789ABCDEFGHIJKLMNOP', 'qrstuvwxyzabcdefghijklmnop') AS word", "n")
    per = spelling.blocks(words, chunk=64).filter("listed").groupBy("size", "bucket").count()
    assert per.agg({"count": "max"}).first()[0] < 64 * 4
    listed = spelling.blocks(words, chunk=64).filter("listed").groupBy("size", "side", "half", "word").count()
    assert listed.filter("`count` <> 1").isEmpty()
