"""The report reads texts twice; its results are those of the single analyses."""

import re

import pytest

from hearsay import fixtures as fx
from hearsay.operators.sentiment import build_lexicon, label_sentiment
from hearsay.operators.spool import spool
from hearsay.plans import forecast, interaction, opinion, report, volume, words


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    comments = spool(fx.full_comments(spark, sf_dir), "comments")
    lexicon = spool(build_lexicon(fx.corpus(spark, sf_dir), keep_common=True), "lexicon")
    analyses = report.explore(comments, lexicon, fx.STOP_WORDS, fx.NEGATIONS, fx.ALIASES)
    return comments, lexicon, analyses


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_words(parts):
    comments, lexicon, analyses = parts
    assert rows(analyses["frequent_words_sentiment"]) == rows(
        words.frequent_words(comments, lexicon, stop_words=fx.STOP_WORDS)
    )
    high = interaction.high_conversion(comments)
    assert rows(analyses["high_conversion_words"]) == rows(words.top_words(high, stop_words=fx.STOP_WORDS))


def test_sentiment(parts):
    comments, lexicon, analyses = parts
    labelled = label_sentiment(comments, lexicon, fx.NEGATIONS, carry=["ip_location"])
    assert rows(analyses["sentiment_per_ip_location"]) == rows(opinion.sentiment_by(labelled, "ip_location"))
    examples = analyses["high_conversion_content_examples"]
    assert examples.count() == 10 and set(examples.columns) == {
        "comment_id", "content", "sentiment", "share_conversion_rate"
    }


def test_totals_of_shared_texts_are_the_same(spark, sf_dir, parts):
    _, lexicon, analyses = parts
    texts = fx.texts(spark, sf_dir).withColumnRenamed("comment_id", "doc_id")
    others = report.explore(fx.comments(spark, sf_dir), lexicon, fx.STOP_WORDS, fx.NEGATIONS, fx.ALIASES, texts=texts)
    assert set(others) == set(analyses)
    for name in analyses:
        assert rows(others[name]) == rows(analyses[name]), name


def test_words_of_shared_texts_are_shuffled_as_totals_only(spark, sf_dir, parts, monkeypatch):
    kept = {}
    monkeypatch.setattr(report, "spool", lambda df, name: kept.setdefault(name, spool(df, name)) and kept.update({f"{name} from": df}) or kept[name])
    texts = fx.texts(spark, sf_dir).withColumnRenamed("comment_id", "doc_id")
    report.explore(fx.comments(spark, sf_dir), parts[1], fx.STOP_WORDS, fx.NEGATIONS, fx.ALIASES, texts=texts)
    plan = kept["words from"]._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "doc_id" in k and "word" in k]


def test_grouped_results_are_those_of_single_analyses(parts):
    comments, lexicon, analyses = parts
    single = {
        "posts_per_hour": volume.posts_per_hour, "posts_per_day": volume.posts_per_day, "event_stages": volume.event_stages,
        "ip_location_counts": volume.ip_location_counts, "gender_ratio": volume.gender_ratio,
        "interaction_per_gender": interaction.interaction_per_gender, "shares_by_ip_location": interaction.shares_by_location,
        "avg_posts_per_gender": volume.posts_per_user_by_gender, "top_100_opinion_leaders": interaction.top_users,
        "extremely_high_likes_count": interaction.extreme_count, "interaction_percentiles": interaction.percentiles,
        "average_share_conversion_rate": interaction.average_share_conversion, "interaction_prediction": forecast.hourly_forecast,
    }
    for name, analysis in single.items():
        assert rows(analyses[name]) == rows(analysis(comments)), name


def test_labels_are_read_for_examples_only(parts):
    """All other results start from the totals, the counted values or the words."""
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles()) for name, df in parts[2].items()}
    assert [name for name, plan in plans.items() if "/labelled-" in plan] == ["high_conversion_content_examples"]


def test_nulls_and_no_rows(spark):
    schema = "comment_id BIGINT, user_id BIGINT, created_at TIMESTAMP_NTZ, content STRING, likes BIGINT, comments BIGINT, shares BIGINT, " \
             "ip_location STRING, gender STRING"
    lexicon = spark.createDataFrame([("good", 1, 1)], "word STRING, polarity INT, freq INT")
    some = spark.createDataFrame([(1, None, None, "good", 20_000, None, 1, None, None), (2, 7, None, None, None, 2, 3, None, "f")], schema)
    for comments in (some, some.limit(0)):
        analyses = report.explore(comments, lexicon)
        got = {name: rows(analyses[name]) for name in analyses}
        assert got["extremely_high_likes_count"] == [(comments.count() // 2,)] and got["posts_per_day"] == []
        assert got["gender_ratio"] == rows(volume.gender_ratio(comments))
        assert got["avg_posts_per_gender"] == rows(volume.posts_per_user_by_gender(comments))
        assert got["interaction_per_gender"] == rows(interaction.interaction_per_gender(comments))
        assert got["average_share_conversion_rate"] == rows(interaction.average_share_conversion(comments))
