import collections
import random

import pytest

from hearsay.llm import mixing, packing, quality


# --- mixing ---


def test_mix_of_odd_rows(odd_docs, odd_rows):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    sizes = collections.Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mix(odd_docs).exceptAll(mixing.mix(odd_docs)).isEmpty()


def _filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_repeated_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 3, 50, 400, 9000]) + rnd.randint(0, 9) for s in ["a", "B", "é", "z", "", "m", None][:3 + seed]}
    rows = [(1, s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "doc_id INT, source STRING, size BIGINT")).collect()}
    assert got == pytest.approx(_filled(sizes))


def test_taken_words_are_near_the_target(spark, sf_dir):
    from hearsay.llm.queries import op3_mixing

    by_source = collections.defaultdict(list)
    for r in op3_mixing(spark, sf_dir).collect():
        by_source[r.source].append(r)
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows)


def test_mixed_rows_keep_all_columns(odd_docs):
    rows = mixing.mixed(odd_docs)
    assert rows.schema.names == odd_docs.schema.names
    copies = collections.Counter((r.doc_id, r.text) for r in rows.collect())
    expected = collections.Counter()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in mixing.mix(odd_docs).collect():
        if r.copies:
            expected[r.doc_id, texts[r.doc_id]] += r.copies
    assert copies == expected


def test_mix_of_no_rows(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


# --- packing ---


def _check_bins(rows, lengths):
    bins = collections.defaultdict(list)
    for r in rows:
        if r.bin_id is None:
            assert r.n_words == 0
        else:
            bins[r.bin_id].append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at
            at += r.n_words
        assert at == parts[0].bin_words and parts[0].bin_length == min(n for n in lengths if n >= at)


def test_packing_loses_no_word(odd_docs, odd_rows):
    rows = packing.pack(odd_docs).collect()
    _check_bins(rows, packing.LENGTHS)
    words = collections.Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    expected = collections.Counter()
    for r in odd_rows:
        expected[r[0]] += len((r[1] or "").encode().split())
    assert words == expected


def test_packing_in_several_shards(spark, sf_dir):
    from hearsay.llm.tables import documents

    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = packing.pack(docs, shard_pieces=30).collect()
    assert len({r.bin_id.split("-")[0] for r in rows if r.bin_id}) > 3
    _check_bins(rows, packing.LENGTHS)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) and len({r.doc_id for r in rows}) == docs.count()
    assert packing.pack(docs, shard_pieces=30).exceptAll(packing.pack(docs, shard_pieces=30)).isEmpty()


def _plain_best_fit(sizes, lengths, bin_cost):
    """The same rules by linear searches."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        size = left[0]
        fitting = [b for b in bins if b["room"] >= size]
        if fitting:
            b = min(fitting, key=lambda b: b["room"])
        else:
            def filled(length):
                room, rest = length - size, left[1:]
                while (fit := max((s for s in rest if s <= room), default=0)) > 0:
                    rest.remove(fit)
                    room -= fit
                return length - room
            length = min((n for n in lengths if n >= size), key=lambda n: (packing.cost(n, bin_cost) / filled(n), n))
            b = {"room": length, "content": 0}
            bins.append(b)
        b["room"] -= size
        b["content"] += size
        left.pop(0)
    return sorted(b["content"] for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_matches_linear_searches(seed):
    rnd = random.Random(seed)
    lengths = (8, 16, 40)
    sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 60))]
    bin_of, start, length, content = packing.best_fit(sizes, lengths, 2)
    assert sorted(content.tolist()) == _plain_best_fit(sizes, lengths, 2)
    assert all(n == min(x for x in lengths if x >= c) for n, c in zip(length, content))


def test_sequences_hold_the_words_in_order(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd e"), (2, "f g"), (3, None), (4, "h")], "doc_id INT, text STRING")
    placed = packing.pack(docs, lengths=(2, 4))
    rows = packing.sequences(docs, placed).collect()
    assert sorted(w for r in rows for w in r.text.split()) == list("abcdefgh")
    assert all(len(r.text.split()) == r.bin_words <= r.bin_length for r in rows)


def test_packing_of_no_rows(no_docs):
    assert packing.pack(no_docs).count() == 0


# --- quality rules ---


def _measures(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_match_brute_force(odd_docs, odd_rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(odd_docs).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *_measures(r[1])) for r in odd_rows], key=str)


def test_verdicts_follow_the_rules(odd_docs):
    for r in quality.judge(odd_docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_runs_no_python(odd_docs):
    plan = quality.judge(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality_of_no_rows(no_docs):
    assert quality.judge(no_docs).count() == 0
