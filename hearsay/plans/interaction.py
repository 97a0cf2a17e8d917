"""Likes, comments and shares: extremes, averages, conversion, leading users."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import clock
from hearsay.functions.rates import as_number, share_conversion, total_interaction
from hearsay.operators import ranks
from hearsay.operators.spool import spool
from hearsay.schemas import COUNT_COLUMNS


def percentiles(
    comments: DataFrame, columns: Sequence[str] = COUNT_COLUMNS, p: float = 0.99, exact: bool = True
) -> DataFrame:
    """``metric, p99`` (named after ``p``), rounded to 2 digits.

    ``exact=False`` estimates with a bounded sketch in a single pass.
    """
    if exact:
        return percentiles_of(ranks.counted(comments, columns), p)
    marks = comments.agg(*[F.percentile_approx(c, p, 10_000).alias(c) for c in columns])
    return _named(marks.unpivot([], list(columns), "metric", "value"), p)


def percentiles_of(counts: DataFrame, p: float = 0.99) -> DataFrame:
    """Exact ``percentiles`` from the values as ``ranks.counted`` gives them."""
    return _named(ranks.values_in(counts, ranks.interpolated(p)), p)


def _named(values: DataFrame, p: float) -> DataFrame:
    name = f"p{p * 100:g}".replace(".", "_")
    return values.select("metric", F.round(F.col("value").cast("double"), 2).alias(name))


# --- percentiles of any range of days ------------------------------------------


def sketch_size(rank_error: float) -> int:
    """The ``k`` of KLL sketches whose ranks are off by ``rank_error`` of all values at most (in 99 of 100 cases)."""
    return min(65_535, max(8, math.ceil((2.296 / rank_error) ** (1 / 0.9021))))


def sketches(
    comments: DataFrame, columns: Sequence[str] = COUNT_COLUMNS, by: Sequence[str] = ("ip_location",),
    rank_error: float = 0.01, tz: str | None = None,
) -> DataFrame:
    """``date, by..., columns...``: a mergeable sketch of the values of each column.

    It is a table to be stored: ``percentiles_of_sketches`` answers from it for any days and groups,
    without comments being read again.  Comments without a readable time are left out, and so are NULL values.
    """
    dated = comments.select(clock.day(F.col("created_at"), tz).alias("date"), *by,
                            *[F.col(c).cast("bigint").alias(c) for c in columns])
    return dated.filter(F.col("date").isNotNull()).groupBy("date", *by).agg(
        *[F.kll_sketch_agg_bigint(c, F.lit(sketch_size(rank_error))).alias(c) for c in columns])


def percentiles_of_sketches(
    stored: DataFrame, p: float = 0.99, by: Sequence[str] = ("date",), columns: Sequence[str] = COUNT_COLUMNS
) -> DataFrame:
    """``by..., metric, n, value`` from ``sketches``, merged over all other groups; no row for columns without values."""
    merged = stored.groupBy(*by).agg(*[F.kll_merge_agg_bigint(c).alias(c) for c in columns])
    sized = merged.unpivot(list(by), list(columns), "metric", "sketch").withColumn("n", F.kll_sketch_get_n_bigint("sketch"))
    return sized.filter("n > 0").select(
        *by, "metric", "n", F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("value"))


def extreme_count(comments: DataFrame, threshold: int = 10_000) -> DataFrame:
    """``count`` of the comments with more likes than ``threshold``."""
    return comments.filter(F.col("likes") > threshold).agg(F.count("*").alias("count"))


def interaction_per_gender(comments: DataFrame) -> DataFrame:
    """``gender, avg_likes, avg_comments, avg_shares``, rounded to 2 digits."""
    return comments.groupBy("gender").agg(
        *[F.round(F.avg(c), 2).alias(f"avg_{c}") for c in COUNT_COLUMNS]
    )


def shares_by_location(comments: DataFrame) -> DataFrame:
    """``ip_location, total_shares``, most first."""
    return (
        comments.groupBy("ip_location").agg(F.sum(F.col("shares").cast("bigint")).alias("total_shares"))
        .orderBy(F.desc("total_shares"), "ip_location")
    )


def average_share_conversion(comments: DataFrame) -> DataFrame:
    """``average_rate`` of shares in all interaction, 4 digits; NULL for no comments."""
    return comments.agg(F.round(F.avg(share_conversion()), 4).alias("average_rate"))


def top_conversion(
    comments: DataFrame, n: int = 10, carry: Sequence[str] = (), key: str = "comment_id"
) -> DataFrame:
    """``key, carry..., share_conversion_rate`` of the ``n`` highest rates."""
    rated = comments.select(key, *carry, share_conversion().alias("rate"))
    return rated.orderBy(F.desc("rate"), key).limit(n).select(
        key, *carry, F.round("rate", 6).alias("share_conversion_rate")
    )


def _id_number(comments: DataFrame, key: str) -> Column:
    """Ids as whole numbers in their order; ids of other types by their hash."""
    kind = dict(comments.dtypes)[key]
    return F.col(key).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)


def counted_rates(comments: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``metric, number, n`` of the conversion rate, as whole numbers, and of other ``columns``."""
    return ranks.counted(comments.withColumn("rate", as_number(share_conversion())), ["rate", *columns])


def is_high_conversion(
    comments: DataFrame, share: float = 0.1, key: str = "comment_id", counts: DataFrame | None = None
) -> Column:
    """Whether a comment is in the top ``share`` of ``comments`` by conversion rate.

    These are the first ``floor(share * n)`` comments, one at least, by falling rate and,
    among equals, by id (for ids that are not whole numbers by their hash).  The last rate in
    is found from the counts of all rates (``counts``, from ``counted_rates``, if they are there
    already), the last id in at that rate from the comments that have it; no table is sorted.
    """
    # Single numbers are fetched one after the other: one plan with all of them
    # nested takes longer to plan than to run.
    rates = (spool(counted_rates(comments), "rates") if counts is None else counts).filter("metric = 'rate'")
    total = rates.agg(F.sum("n")).first()[0]
    if not total:
        return F.lit(False)
    wanted = max(1, math.floor(share * total))
    mark = ranks.value_in(rates, total - wanted)
    above, at_mark = rates.agg(F.sum(F.when(F.col("number") > mark, F.col("n")).otherwise(0)),
                               F.sum(F.when(F.col("number") == mark, F.col("n")).otherwise(0))).first()
    rate = as_number(share_conversion())
    if above + at_mark == wanted:
        return rate >= mark
    tied = comments.select(rate.alias("rate"), _id_number(comments, key).alias("id")).filter(F.col("rate") == mark)
    last = ranks.value_at(tied, "id", wanted - above - 1)
    return (rate > mark) | ((rate == mark) & (_id_number(comments, key) <= last))


def high_conversion(comments: DataFrame, share: float = 0.1, key: str = "comment_id") -> DataFrame:
    """The comments in the top ``share`` by conversion rate, with all their columns."""
    return comments.filter(is_high_conversion(comments, share, key))


def top_users(comments: DataFrame, n: int = 100) -> DataFrame:
    """``user_id, total_interaction`` of the ``n`` users with the most interaction."""
    return (
        comments.filter(F.col("user_id").isNotNull())
        .groupBy("user_id").agg(F.sum(total_interaction()).alias("total_interaction"))
        .orderBy(F.desc_nulls_last("total_interaction"), "user_id").limit(n)
    )
