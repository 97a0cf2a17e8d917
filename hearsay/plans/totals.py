"""All grouped totals of a comment table in one aggregation over grouping sets.

The sets share one scan and one exchange; rows are combined on the map side, so what is exchanged is
about one row per group and task.  The analyses are then small steps from the rows of their set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import clock
from hearsay.functions.rates import share_conversion, total_interaction
from hearsay.plans.opinion import HOT_LIKES
from hearsay.schemas import COUNT_COLUMNS, SENTIMENTS

SETS = {
    "all": (), "day": ("date",), "hour_of_day": ("post_hour",), "hour": ("hour",), "place": ("ip_location",),
    "gender": ("gender",), "sentiment": ("sentiment",), "user": ("gender", "user_id"),
}
EXTREME_LIKES = 10_000


def totals(labelled: DataFrame, tz: str | None = None, hot: int = HOT_LIKES, extreme: int = EXTREME_LIKES) -> DataFrame:
    """``which``, the keys of ``SETS``, and the measures of every group; without ``user_id`` no set ``user``."""
    sets = {name: keys for name, keys in SETS.items() if "user_id" in labelled.columns or "user_id" not in keys}
    names = list(dict.fromkeys(key for keys in sets.values() for key in keys))
    moment = F.col("created_at")
    keyed = labelled.withColumns({
        "date": clock.day(moment, tz), "post_hour": clock.hour_of_day(moment, tz), "hour": clock.hour_index(moment, tz),
        "rate": share_conversion(), "total": total_interaction()}).select(*names, *COUNT_COLUMNS, "rate", "total",
                                                                         F.col("sentiment").alias("label"))
    # A set is told by which keys it lacks, not by nulls: a key can be null itself.
    number = {name: sum(1 << (len(names) - 1 - i) for i, key in enumerate(names) if key not in keys) for name, keys in sets.items()}
    which = F.coalesce(*(F.when(F.grouping_id() == n, name) for name, n in number.items()))
    return keyed.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *names).agg(
        which.alias("which"), F.count("*").alias("count"), F.count_if(F.col("likes") > hot).alias("hot"),
        F.count_if(F.col("likes") > extreme).alias("extreme"),
        *(F.count_if(F.col("label") == s).alias(s) for s in SENTIMENTS),
        *(F.avg(c).alias(f"avg_{c}") for c in COUNT_COLUMNS),
        F.sum(F.col("shares").cast("bigint")).alias("total_shares"), F.sum("total").alias("interaction"),
        F.avg("rate").alias("avg_rate"))


def of(found: DataFrame, name: str) -> DataFrame:
    """The rows of one set; those without a time are left out of a series."""
    rows = found.filter(F.col("which") == name)
    if name in ("day", "hour_of_day", "hour"):
        rows = rows.filter(F.col(SETS[name][0]).isNotNull())
    return rows


def posts_per_user(users: DataFrame) -> DataFrame:
    """``gender, avg_posts`` from the set ``user``."""
    known = F.col("user_id").isNotNull()
    return users.groupBy("gender").agg(F.round(F.sum(F.when(known, F.col("count")).otherwise(0)) / F.when(
        F.count_if(known) > 0, F.count_if(known)), 4).alias("avg_posts"))


def top_users(users: DataFrame, n: int = 100) -> DataFrame:
    """``user_id, total_interaction`` of the ``n`` users with the most, from the set ``user``."""
    summed = users.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.sum("interaction").alias("total_interaction"))
    return summed.orderBy(F.desc_nulls_last("total_interaction"), "user_id").limit(n)
