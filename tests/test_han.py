"""Words found in texts without spaces, and the best path through them."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hearsay.operators.lookup import Bound, held, sought
from hearsay.plans import han
from hearsay.plans.words import top_words

WORDS = ["手机", "电池", "屏幕", "很好", "声音大", "价格", "服务态度", "快", "慢", "不"]


def _texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 12))) + draw.choice(["。", "", "! ok Go"]) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(_texts(400, 1))) + [(1000, None), (1001, ""), (1002, "only latin"), (1003, "手机" * 400)]
    return spark.createDataFrame(rows, "comment_id BIGINT, content STRING").repartition(3)


def _plain_words(rows):
    """Counts, cohesion and freedom of all strings from dictionaries."""
    counts = collections.Counter()
    for text in rows:
        for run in re.findall("[一-鿿]+", text or ""):
            counts.update(run[i:i + k] for k in range(1, 6) for i in range(len(run) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def freedom(gram, longer):
        beside = [n for g, n in counts.items() if len(g) == len(gram) + 1 and longer(g) == gram]
        rest = counts[gram] - sum(beside)
        beside += [rest] if rest else []
        return math.log(counts[gram]) - sum(n * math.log(n) for n in beside) / counts[gram]

    found = {}
    for gram, n in counts.items():
        if 2 <= len(gram) <= 4 and n >= 20:
            cohesion = min(math.log(n * total / counts[gram[:k]] / counts[gram[k:]]) for k in range(1, len(gram)))
            sides = freedom(gram, lambda g: g[1:]), freedom(gram, lambda g: g[:-1])
            if min(cohesion, *sides) >= 1:
                found[gram] = (n, *(round(x, 6) for x in (cohesion, *sides)))
    return found, {g: n for g, n in counts.items() if len(g) == 1}


def test_found_words_match_plain_counts(texts):
    found, single = _plain_words([r.content for r in texts.collect()])
    got = {r.word: (r["count"], r.cohesion, r.left_freedom, r.right_freedom) for r in han.discover(texts).collect()}
    assert {w: v for w, v in got.items() if len(w) == 1} == {w: (n, None, None, None) for w, n in single.items()}
    many = {w: v for w, v in got.items() if len(w) > 1}
    assert set(many) == set(found) and {"手机", "电池", "屏幕", "很好", "价格"} <= set(many)
    assert all(many[w] == pytest.approx(found[w], abs=2e-6) for w in found)


def _plain_path(run, counts):
    total = sum(n for w, n in counts.items() if len(w) == 1)
    cost = lambda w: round(1000 * math.log(total / counts[w])) if w in counts else (
        round(1000 * math.log(2 * total)) if len(w) == 1 else None)
    best = [(0, [])]
    for end in range(1, len(run) + 1):
        ways = [(best[end - k][0] + cost(run[end - k:end]), k, best[end - k][1] + [run[end - k:end]])
                for k in range(1, min(4, end) + 1) if cost(run[end - k:end]) is not None]
        least = min(ways, key=lambda w: w[:2])
        best.append((least[0], least[2]))
    return best[-1][1]


@pytest.mark.parametrize("bound", [Bound(), Bound(rows=3)])
def test_best_path_matches_dynamic_programming(spark, bound):
    draw = random.Random(2)
    letters = "甲乙丙丁"
    counts = {c: draw.randrange(1, 400) for c in letters[:3]}
    counts |= {"".join(draw.choice(letters) for _ in range(draw.randrange(2, 5))): draw.randrange(1, 60) for _ in range(40)}
    runs = sorted({"".join(draw.choice(letters + "戊") for _ in range(draw.randrange(1, 30))) for _ in range(200)}) + ["甲乙" * 300]
    words = spark.createDataFrame(list(counts.items()), "word STRING, count BIGINT")
    cut = han.segment(spark.createDataFrame([(r,) for r in runs], "run STRING"), words, bound=bound)
    assert {r.run: r.words for r in cut.collect()} == {run: _plain_path(run, counts) for run in runs}


def test_every_text_keeps_its_row(spark, texts):
    cut = han.segmented(texts, han.discover(texts))
    rows = {r.comment_id: r.words for r in cut.collect()}
    assert len(rows) == 404 and rows[1000] == rows[1001] == [] and rows[1002] == ["only", "latin"]
    for row in texts.filter("content IS NOT NULL").collect():
        assert "".join(rows[row.comment_id]) == "".join(re.findall("[a-z一-鿿]", row.content.lower()))
    top = {r.word for r in top_words(cut.withColumnRenamed("words", "content"), 7, stop_words=(), tokenizer=han.segmented_words).collect()}
    assert "手机" in top and len([w for w in top if len(w) > 1]) >= 5


def test_no_text_no_words(spark):
    none = spark.createDataFrame([], "comment_id BIGINT, content STRING")
    assert han.discover(none).count() == 0 and han.segmented(none, han.discover(none)).count() == 0
    latin = spark.createDataFrame([(1, "abc def")], "comment_id BIGINT, content STRING")
    assert [r.words for r in han.segmented(latin, han.discover(latin)).collect()] == [["abc", "def"]]


def test_plans_hold_no_python(spark, texts):
    words = han.discover(texts)
    for df in (words, han.segmented(texts, words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
    assert han.segmented(texts, words).agg(F.count("*")).first()[0] == 404


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_texts_are_cut_where_they_are(spark, texts, monkeypatch):
    """No text, piece or word is exchanged or written on the way."""
    words = han.spool(han.discover(texts), "words")
    written = []
    monkeypatch.setattr(han, "spool", lambda df, name, spool=han.spool: written.append(name) or spool(df, name))
    cut = han.segmented(texts, words)
    assert set(written) == {"runs", "costs", "cuts"}
    plan = cut._jdf.queryExecution().executedPlan().toString().splitlines()
    own = [line for line in plan if not line.strip().startswith(":")]  # without those of the held lists
    exchanges = [line for line in own if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]  # that of the texts given
    assert not any("Aggregate" in line or "Join" in line for line in own)
    # The lists are read in the projection that cuts, so no row holds them.
    assert sum("regexp_extract_all" in line and "ubquery" in line for line in own) == 1


@pytest.mark.parametrize("kept, twice", [(0, False), (3, True), (1000, False)])
def test_texts_in_place_as_by_join(spark, texts, kept, twice):
    """Whatever runs are held, with many words, unknown characters, and rows that share a key or have none."""
    odd = spark.createDataFrame([(2000, "手机很好甲乙丙 abc é屏幕"), (2001, "甲" * 50 + "\U00020000手机"), (None, "电池"), (2002, "ÄÖ")], texts.schema)
    texts = texts.unionByName(odd)
    if twice:
        texts = texts.unionByName(texts.withColumn("content", F.concat(F.lit("声音大 x"), "content")))
    texts = texts.withColumn("label", F.coalesce(F.col("comment_id"), F.lit(0)) % 2)
    words = han.spool(han.discover(texts.filter("comment_id < 200")), "words")
    runs = han.spool(han.run_counts(texts), "runs")
    cuts = han.frequent_cuts(runs, words, bound=Bound(rows=kept))
    assert cuts.count() <= kept and (kept == 0 or cuts.count() > 0)
    joined = _rows(han.segmented(texts, words, bound=Bound(rows=3)))
    assert len(joined) == 408 and _rows(han.segmented(texts, words, cuts=cuts)) == joined
    carried = _rows(han.segmented(texts, words, carry=["label"], cuts=cuts))
    assert carried == _rows(han.segmented(texts, words, carry=["label"], bound=Bound(rows=3)))
    assert [(k, w) for k, _, w in carried] == joined


def test_longest_words_of_one_character(spark, texts):
    words = han.discover(texts)
    whole = han.segmented(texts, words, longest=1).select(F.array_join("words", "").alias("all"), F.size("words").alias("n"))
    assert whole.filter("all RLIKE '^[一-鿿]*$' AND char_length(all) <> n").isEmpty()
    assert _rows(han.segmented(texts, words, longest=1)) == _rows(han.segmented(texts, words, longest=1, bound=Bound(rows=3)))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_held_rows_are_found(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("name"), F.col("id").alias("number"))
    asked = spark.range(600).select("id", F.concat(F.lit("k"), "id").alias("name"), held(rows, "name", "number", n).alias("table"))
    found = asked.select("id", F.get(F.transform(F.array("table"), lambda table: sought(table, F.col("name"))), F.lit(0)).alias("number"))
    assert {r.id: r.number for r in found.collect()} == {k: k if k < n else None for k in range(600)}
