"""Properties of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from hearsay.operators import lookup
from hearsay.operators.sentiment import label_sentiment

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PAIRING = ("CartesianProduct", "BroadcastNestedLoopJoin")
NO_TEXT = (
    "posts_per_hour", "posts_per_day", "event_stages", "event_waves", "ip_location_counts", "gender_ratio", "percentiles_by_day",
    "interaction_p99", "top_opinion_leaders", "avg_share_conversion", "hourly_interaction_forecast",
)
# Several analyses of these run while the query is built; the rest are lazy plans.
BUNDLES = {"results_bundle", "learning_bundle"}
CORE = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    built = {}

    def of(name):
        if name not in built:
            built[name] = plan(entry.queries()[name](spark, sf_dir))
        return built[name]

    return of


@pytest.mark.parametrize("name", sorted(set(CORE) - BUNDLES))
def test_no_python_and_no_pairing_joins(plans, name):
    assert not [op for op in PYTHON + PAIRING if op in plans(name)]


@pytest.mark.parametrize("name", ["null_drop_audit", "sentiment_labels", "sentiment_by_location", "nb_predictions",
                                  "tokens", "corpus_word_counts", "daily_class_counts", "high_conversion_ties"])
def test_no_exchange_carries_texts(spark, sf_dir, name):
    query = entry.queries()[name](spark, sf_dir)._jdf.queryExecution()
    exchanges = query.executedPlan().toString().split("Exchange hashpartitioning")[1:]
    # What an exchange gets is listed on the line below it.
    # Spreading the small test tables is the fixtures' own exchange.
    exchanges = [e for e in exchanges if "REPARTITION_BY_NUM" not in e.split("\n")[0]]
    assert not [e for e in exchanges if re.search(r"(Project|Scan parquet|Filter)[^\n]*\b(text|content|review)#", e.split("\n")[1])]


@pytest.mark.parametrize("name", NO_TEXT)
def test_texts_are_not_read_for_figures(plans, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans(name))
    assert schemas and not any("text:" in schema for schema in schemas)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(entry.queries()["extreme_likes_count"](spark, sf_dir))
    assert "props" not in text and "ts#" not in text


def test_top_k_needs_no_full_sort(plans):
    for name in ("top_opinion_leaders", "frequent_words_sentiment", "conversion_top_words", "event_peak"):
        assert "TakeOrderedAndProject" in plans(name), name


@pytest.mark.parametrize("name", ["frequent_words_sentiment", "conversion_top_words", "sentiment_labels",
                                  "nb_predictions", "corpus_word_counts", "tokens"])
def test_texts_are_tokenised_once(spark, sf_dir, name):
    optimized = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    scans = len(re.findall(r"Relation \[doc_id#\w+,text#", optimized))
    assert 0 < optimized.count("octet_length(") <= scans


def _comments(spark):
    return spark.createDataFrame([(1, "good bad")], "comment_id BIGINT, content STRING")


def _lexicon(spark):
    return spark.createDataFrame([("good", 1, 9), ("bad", -1, 2)], "word STRING, polarity INT, freq BIGINT")


def test_a_small_lexicon_is_broadcast_and_only_sums_are_shuffled(spark):
    text = plan(label_sentiment(_comments(spark), _lexicon(spark)))
    text = text.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(shuffles) == 1 and shuffles[0].startswith("comment_id")


def test_a_large_lexicon_is_joined_beside_its_frequent_words(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(label_sentiment(_comments(spark), _lexicon(spark), bound=lookup.Bound(rows=1)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text


def test_open_words_are_shuffled_by_word_only(spark):
    """Not summed by text and word first, which would be one more shuffle of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(label_sentiment(_comments(spark), _lexicon(spark), bound=lookup.Bound(rows=1)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text.split("Initial Plan")[0])]
    assert {k.rsplit(", ", 1)[0] for k in keys} == {"comment_id", "word"}


def test_texts_of_open_words_only_are_kept(spark):
    tokens = spark.createDataFrame([(1, "bad"), (1, "new"), (2, "new"), (None, "bad"), (3, None)], "id BIGINT, word STRING")
    weights = _lexicon(spark).withColumnRenamed("polarity", "weight")
    sums = lookup.score_tokens(tokens.selectExpr("*", "2 AS sign"), weights, ["id"], lookup.Bound(rows=1))
    assert {tuple(r) for r in sums.collect()} == {(1, -2), (2, 0), (3, 0), (None, -2)}
