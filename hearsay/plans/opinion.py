"""Sentiment totals.  Input: comments with a ``sentiment`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import clock
from hearsay.schemas import SENTIMENTS

HOT_LIKES = 500


def _per_sentiment():
    return [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]


def sentiment_counts(labelled: DataFrame, min_likes: int | None = None) -> DataFrame:
    """``sentiment, count``; with ``min_likes`` only of comments with more likes."""
    if min_likes is not None:
        labelled = labelled.filter(F.col("likes") > min_likes)
    return labelled.groupBy("sentiment").count()


def sentiment_by(labelled: DataFrame, key: str) -> DataFrame:
    """``key, positive, negative, neutral``: counts, 0 where there are none."""
    return labelled.groupBy(key).agg(*_per_sentiment())


def sentiment_over_time(labelled: DataFrame, tz: str | None = None) -> DataFrame:
    """``date, positive, negative, neutral`` per day, in order."""
    dated = labelled.select(clock.day(F.col("created_at"), tz).alias("date"), "sentiment")
    return dated.filter(F.col("date").isNotNull()).groupBy("date").agg(*_per_sentiment()).orderBy("date")
