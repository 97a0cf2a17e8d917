import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import lm_scoring, repeats, suffix_tree
from hearsay.llm.packed import Hasher, flat, shingles, words
from hearsay.llm.suffix_sort import suffix_array
import pyarrow as pa


# --- suffix arrays ---


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26])
def test_suffix_array_is_the_sorted_order(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(300):
        s = [rnd.randrange(alphabet) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.3:
            s = s[:8] * 4
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_a_stretch_that_all_strings_hold_is_sorted_as_one_symbol(monkeypatch):
    rnd = random.Random(2)
    texts, shared, several, symbols = [], [], [], []
    for i in range(200):
        name = rnd.randrange(3)
        middle = bytes([65 + name]) * 176
        left, right = (bytes(rnd.choice(b"ab") for _ in range(n)) for n in (rnd.randint(12, 24), rnd.randint(12, 24)))
        texts.append(left[-12:] + middle + right[:12] if i % 3 else left + middle + right)
        shared.append((name, texts[-1].index(middle), texts[-1].index(middle) + 176))
        several.append(i % 50 == 7)
    kept = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda whole: (symbols.append(len(whole)), kept(whole))[1])
    expected = repeats.repeated_starts(texts, several)
    got = repeats.repeated_starts(texts, several, shared=shared)
    assert [x.tolist() for x in got] == [_same_place(texts, several, i) for i in range(len(texts))]
    assert all(set(a.tolist()) <= set(b.tolist()) for a, b in zip(got, expected))
    assert symbols[0] == sum(map(len, texts)) + 200 and symbols[1] == symbols[0] - 175 * 200


def _same_place(texts, several, i):
    """Starts in text i of strings of 200 bytes that start elsewhere with the stretch of 176 at the same place."""
    def strings(t):
        at = next(k for k in range(len(t)) if len(set(t[k:k + 176])) == 1)
        return [(t[s:s + 200], at - s) for s in range(len(t) - 199)]

    if several[i]:
        return list(range(len(texts[i]) - 199))
    others = collections.Counter(x for t in texts for x in strings(t))
    return [s for s, x in enumerate(strings(texts[i])) if others[x] > 1]


def _plain(texts, length):
    """What is removed, by counting every string."""
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _check_repeats(docs, rows, **options):
    got = sorted(repeats.cleaned(docs, **options).collect(), key=str)
    texts = [(r[1] or "").encode() for r in rows]
    expected = [(r[0], *x) for r, x in zip(rows, _plain(texts, 200))]
    assert sorted([tuple(r) for r in got], key=str) == sorted(expected, key=str)


def test_repeats_match_brute_force_on_odd_rows(odd_docs, odd_rows):
    _check_repeats(odd_docs, odd_rows)


@pytest.mark.parametrize("options", [{}, {"most_runs": 1, "widths": (7, 1)}, {"most_runs": 3}])
def test_repeats_match_brute_force_on_edited_copies(spark, odd_docs, options):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdef ") for _ in range(700))
    rows = []
    for i in range(24):
        text = "".join(rnd.choice("abcdefg ") for _ in range(rnd.randint(0, 300))) + passage[rnd.randint(0, 300):] + "é" * rnd.randint(0, 9)
        at = rnd.randint(0, len(text) - 1)
        rows.append((i, text[:at] + "#" + text[at:] if i % 3 else text))
    rows.append((99, "abc " * 400))
    _check_repeats(spark.createDataFrame(rows, "doc_id INT, text STRING"), rows, **options)


def test_ranges_do_not_grow_with_copies_of_a_row(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    near = text[:350] + "#" + text[350:]

    def ranges(copies):
        rows = spark.range(copies).select(F.lit(7).alias("row"), F.lit(text).alias("text")).union(
            spark.range(1).select(F.lit(8).alias("row"), F.lit(near).alias("text")))
        rows = rows.select(F.col("row").cast("bigint").alias("row"), "text")
        per_row = repeats.covered_bytes(rows).groupBy("row").count().collect()
        return max(r["count"] for r in per_row)

    assert ranges(100_000) == ranges(2)


def test_repeats_of_no_rows(no_docs):
    assert repeats.cleaned(no_docs).count() == 0


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1000)
    rnd = random.Random(1)
    data = np.array([rnd.randrange(97, 120) for _ in range(9000)], dtype=np.uint8)
    anchor, text, start, size, distance, whole = repeats.runs(data, np.array([0, 9000]))
    strings = np.concatenate([np.arange(s, s + n - 199) for s, n in zip(start, size)])
    assert sorted(strings.tolist()) == list(range(8801))
    assert (data[start + distance][:, None] == data[start + distance][:, None]).all()


# --- packed words ---


def test_words_and_shingles_agree_with_python():
    texts = [None, "", " a\x0bb\x0c c\n", "é\xa0x y", "one two three four five six", "z"]
    data, limits = flat(pa.array(texts, pa.string()))
    starts, ends, owner = words(data, limits)
    got = [[] for _ in texts]
    for s, e, o in zip(starts, ends, owner):
        got[o].append(bytes(data[s:e]))
    assert got == [(t or "").encode().split() for t in texts]
    hashes = Hasher(data).ranges(starts, ends)
    found, of = shingles(hashes, owner, 5)
    assert collections.Counter(of.tolist()) == {2: 1, 3: 1, 4: 2, 5: 1}


# --- language-model scores ---


@pytest.fixture(scope="module")
def scored(odd_docs):
    docs = odd_docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False)))
    return lm_scoring.score(docs, least_count=2, least_gain=0.1).collect()


def test_base_scores_match_brute_force(scored, odd_rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(r[0], (r[1] or "").encode().translate(lower).split()) for r in odd_rows]
    learned = [w for k, w in tokens if k is None or k % 4 != 2]
    count = collections.Counter(x for w in learned for x in w)
    total, kinds = sum(count.values()) + len(learned), len(count) + 1
    expected = []
    for k, w in tokens:
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        base += math.log10((len(learned) + 1) / (total + kinds + 1))
        expected.append((k, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_scores_are_log_probabilities(scored):
    assert all(r.score < 0 for r in scored)
    same = {r.score for r in scored if r.doc_id in (0, 1, 2)}
    assert max(same) - min(same) < 1e-9  # texts without words are one end


def _plain_tree(texts, depth, least_count, least_gain):
    """Counts after every context, and the retained ones, by dictionaries."""
    after = collections.defaultdict(collections.Counter)
    for t in texts:
        padded = b"\n" + t
        for i in range(1, len(padded)):
            for d in range(min(depth, i) + 1):
                after[padded[i - d:i]][padded[i]] += 1
    kept = {c for c in after if len(c) <= 1}
    for c, following in after.items():
        if len(c) < 2:
            continue
        total, shorter = sum(following.values()), after[c[1:]]
        mass = sum(shorter.values())
        gain = sum(n * math.log(n / total / (shorter[b] / mass)) for b, n in following.items())
        if total >= least_count and gain >= least_gain * len(following):
            kept.update(c[k:] for k in range(len(c) - 1))
    return after, kept


def _plain_probability(after, kept, context, b):
    p = 1 / 256
    for d in range(len(context) + 1):
        c = context[len(context) - d:]
        if c not in kept:
            break
        total, kinds = sum(after[c].values()), len(after[c])
        p = (after[c][b] + kinds * p) / (total + kinds) if total else p
    return p


def _bytes_of(text):
    return b"".join(w + b" " for w in (text or "").encode().lower().replace(b"\0", b"\1").split()) + b"\n"


def test_tree_scores_match_a_plain_tree(spark):
    rnd = random.Random(3)
    texts = [None, "", "abab abab", *(" ".join(rnd.choice(["the", "then", "THERE", "an", "änd", "a"]) for _ in range(60)) for _ in range(12))]
    docs = spark.createDataFrame([(i, t, i % 4 == 2) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, held_out BOOLEAN")
    got = {r.doc_id: r.tree_score for r in lm_scoring.score(docs.repartition(3), least_count=2, least_gain=0.1).collect()}
    after, kept = _plain_tree([_bytes_of(t) for i, t in enumerate(texts) if i % 4 != 2], suffix_tree.DEPTH, 2, 0.1)
    assert max(map(len, kept)) == suffix_tree.DEPTH
    for i, t in enumerate(texts):
        padded = b"\n" + _bytes_of(t)
        expected = sum(math.log10(_plain_probability(after, kept, padded[max(0, k - suffix_tree.DEPTH):k], padded[k]))
                       for k in range(1, len(padded)))
        assert got[i] == pytest.approx(expected, abs=1e-3)


def test_distributions_sum_to_one(odd_rows):
    data, limits = flat(pa.array([r[1] for r in odd_rows], pa.string()))
    text, cuts, _ = suffix_tree.normalised(data, limits)
    gram, n = np.unique(suffix_tree.grams(text, cuts, 5), return_counts=True)
    pair, m = np.unique(suffix_tree.grams(text, cuts, 2), return_counts=True)
    after_one = np.zeros((256, 256))
    after_one[pair >> 8, pair & 255] = m
    levels, root = suffix_tree.grown(gram, n, after_one, 4, 2, 0.1), suffix_tree.first_order(after_one)
    assert len(levels[2][0])
    for context in gram[::501] & ~np.uint64(255):
        every = suffix_tree.probabilities(levels, root, context | np.arange(256, dtype=np.uint64))
        assert every.sum() == pytest.approx(1, abs=1e-9)


def test_turned_grams_turn_back_and_sort_by_slice():
    values = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    lined = np.sort(suffix_tree.turned(values))
    assert sorted(suffix_tree._straight(lined).tolist()) == sorted(values.tolist())
    at = suffix_tree.slice_limits(lined, 7)
    pairs = [set((suffix_tree._straight(lined[a:b]) >> np.uint64(8) & np.uint64(0xFFFF)).tolist()) for a, b in zip(at, at[1:])]
    assert sum(map(len, pairs)) == len(set.union(*pairs)) and at[0] == 0 and at[-1] == 1000


def test_slices_do_not_matter(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice("xyz") for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, held_out BOOLEAN")
    one = {r.doc_id: r.tree_score for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(suffix_tree, "LEAST_SLICES", 3)
    monkeypatch.setattr(suffix_tree, "SLICE_BYTES", 400)
    other = {r.doc_id: r.tree_score for r in lm_scoring.score(docs).collect()}
    assert one == pytest.approx(other, abs=1e-3)


def _word_docs(spark, n):
    rnd = random.Random(12)
    kinds = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    return spark.createDataFrame([(i, " ".join(rnd.choices(kinds, range(400, 0, -1), k=300)), i % 5 == 0) for i in range(n)],
                                 "doc_id BIGINT, text STRING, held_out BOOLEAN")


@pytest.mark.parametrize("often_bytes", [1, 5_000])
def test_frequent_strings_that_all_tasks_hold_do_not_matter(spark, monkeypatch, often_bytes):
    docs = _word_docs(spark, 60)
    one = {r.doc_id: r.tree_score for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(suffix_tree, "OFTEN_BYTES", often_bytes)
    assert {r.doc_id: r.tree_score for r in lm_scoring.score(docs).collect()} == pytest.approx(one, abs=1e-3)


def test_words_and_strings_of_blocks_travel_packed_and_without_the_frequent_ones(spark, monkeypatch):
    docs = _word_docs(spark, 120).repartition(2).cache()
    tree = suffix_tree.fit(docs.filter("NOT held_out").select("text"))
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    table = lm_scoring.blocks(docs, "doc_id").cache()
    often = spark.sparkContext.broadcast(tree.often)
    assert 0 < len(tree.often[0]) <= suffix_tree.OFTEN_BYTES and (np.diff(tree.often[0].astype(object)) > 0).all()
    learned = lm_scoring.blocks(docs.filter("NOT held_out"), "doc_id")
    assert lm_scoring._asked_grams(learned, tree, often).count() == 0  # few texts: all strings of theirs are frequent
    words = lm_scoring._asked_words(table, 3)
    rows = words.agg(F.count("*"), F.max("slice")).first()
    assert table.count() > 3 and rows[0] <= 3 * table.count() and rows[1] == 2
    answers = lm_scoring._counted_words(words, 3).agg(F.sum("n"), F.sum("v")).first()
    spoken = [w for r in docs.filter("NOT held_out").collect() for w in r.text.split()]
    assert tuple(answers) == (len(spoken), len(set(spoken)))


@pytest.fixture
def batches_of_17(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_blocks_are_filled_whatever_the_batches(spark, monkeypatch, batches_of_17):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)  # a batch has 25,500
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(True).alias("held_out"), F.repeat(F.lit("ab "), 500).alias("text")).coalesce(1)
    rows = lm_scoring.blocks(docs, "doc_id").collect()
    assert [k for r in rows for k in r["keys"]] == list(range(400))
    assert sorted(len(r.limits) - 1 for r in rows)[1:] == [13] * 30


def test_empty_texts_do_not_pile_up_for_a_block(spark, monkeypatch, batches_of_17):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1000)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(True).alias("held_out"), F.lit(None).cast("string").alias("text")).coalesce(1)
    rows = lm_scoring.blocks(docs, "doc_id").collect()
    assert [k for r in rows for k in r["keys"]] == list(range(500)) and len(rows) > 3


def test_packed_numbers_come_back():
    for kind in (np.uint64, np.int64, np.float32):
        for n in (0, 1, 1000):
            values = np.arange(n).astype(kind) * kind(3)
            assert (suffix_tree.unpacked_numbers(suffix_tree.packed_numbers(values), kind) == values).all()
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 99, dtype=np.uint64))
    assert (suffix_tree.unpacked_grams(suffix_tree.packed_grams(values)) == values).all()


def test_words_are_named_by_their_bytes():
    rnd = random.Random(9)
    plain = [bytes(rnd.choice(b"ab\x00\x01") for _ in range(rnd.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(4000)]
    plain += [b"a" * n for n in range(1, 60)] + [b"x" * 100_000, b"x" * 99_999 + b"y", b"y" + b"x" * 99_999]
    texts = [b" ".join(plain[:3000]) + b"\n", b"", b" \t", b"\x0b".join(plain[3000:]), b"End"]
    data, limits = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    parts = [suffix_tree.spaced(data, limits)]
    names, owner = lm_scoring._tokens(parts)
    spoken = [w.lower() for t in texts for w in t.split()]
    assert len(names) == len(spoken) and owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert len(set(names.tolist())) == len(set(spoken)) == len(set(zip(spoken, names.tolist())))
    text, cuts, (begins, stops) = parts[0]
    assert [bytes(text[a:b]) for a, b in zip(cuts, cuts[1:])] == [b"".join(w.lower() + b" " for w in t.split()) + b"\n" for t in texts]
    assert [bytes(text[a:b]) for a, b in zip(begins, stops)] == [w + b" " for w in spoken]


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_grams_are_lined_up_by_value(most):
    draw = np.random.default_rng(3)
    for n in (0, 1, 256, 257, 5000, 150_000):
        values = draw.integers(0, 1 << 56, most, dtype=np.uint64)[draw.integers(0, most, n)] << np.uint64(8)
        order, lined = suffix_tree.line(values)
        assert (lined == np.sort(values)).all() and (values[order] == lined).all()
        assert (np.sort(order) == np.arange(n)).all()


def test_only_strings_in_the_shorter_context_are_sought_in_the_longer_one(monkeypatch, odd_rows):
    data, limits = flat(pa.array([r[1] for r in odd_rows], pa.string()))
    text, cuts, _ = suffix_tree.normalised(data, limits)
    gram, n = np.unique(suffix_tree.grams(text, cuts, 7), return_counts=True)
    pair, m = np.unique(suffix_tree.grams(text, cuts, 2), return_counts=True)
    after_one = np.zeros((256, 256))
    after_one[pair >> 8, pair & 255] = m
    levels, root = suffix_tree.grown(gram, n, after_one, 6, 10, 1.0), suffix_tree.first_order(after_one)
    unknown = np.random.default_rng(2).integers(0, 1 << 56, 10_000, dtype=np.uint64)
    sought, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: (sought.append(len(v)), search(a, v, *more, **named))[1])
    suffix_tree.probabilities(levels, root, unknown)
    assert all(len(level[0]) for level in levels) and sum(sought) < 1.5 * len(unknown)


def test_amounts_worked_on_at_once_do_not_matter(spark, monkeypatch):
    docs = _word_docs(spark, 60)
    monkeypatch.setattr(suffix_tree, "OFTEN_BYTES", 5_000)
    one = {r.doc_id: r.tree_score for r in lm_scoring.score(docs, least_count=2).collect()}
    for name, value in (("SORTED_GRAMS", 1000), ("HELD_GRAMS", 500), ("ASKED_GRAMS", 10), ("PIECE_GRAMS", 7)):
        monkeypatch.setattr(suffix_tree, name, value)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 10_000)
    assert {r.doc_id: r.tree_score for r in lm_scoring.score(docs, least_count=2).collect()} == pytest.approx(one, abs=1e-3)


def test_tree_scores_beat_word_counts_on_held_out_texts(spark, sf_dir):
    from hearsay.llm.queries import op1_lm_scoring

    rows = [r for r in op1_lm_scoring(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_of_no_rows(no_docs):
    assert lm_scoring.score(no_docs.withColumn("held_out", F.lit(False))).count() == 0
