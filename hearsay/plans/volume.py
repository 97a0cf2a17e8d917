"""How much is posted: by hour, day, place and gender; the course of an event."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import clock
from hearsay.vocabulary import PROVINCE_ALIASES


def posts_per_hour(comments: DataFrame, tz: str | None = None) -> DataFrame:
    """``post_hour, count`` over all days."""
    hours = comments.select(clock.hour_of_day(F.col("created_at"), tz).alias("post_hour"))
    return hours.filter(F.col("post_hour").isNotNull()).groupBy("post_hour").count().orderBy("post_hour")


def _per_day(comments: DataFrame, tz: str | None) -> DataFrame:
    days = comments.select(clock.day(F.col("created_at"), tz).alias("date"))
    return days.filter(F.col("date").isNotNull()).groupBy("date").count()


def posts_per_day(comments: DataFrame, tz: str | None = None) -> DataFrame:
    """``date, count`` in order; comments without a readable time are left out."""
    return _per_day(comments, tz).orderBy("date")


def event_peak(comments: DataFrame, tz: str | None = None) -> DataFrame:
    """``peak_date, peak_count``: the busiest day, the earliest of equal ones."""
    return peak_of(_per_day(comments, tz))


def peak_of(daily: DataFrame) -> DataFrame:
    return (
        daily.orderBy(F.desc("count"), "date").limit(1)
        .select(F.col("date").alias("peak_date"), F.col("count").alias("peak_count"))
    )


def event_stages(comments: DataFrame, tz: str | None = None) -> DataFrame:
    """``date, count, stage``: onset before the peak day, climax on it, calm after it."""
    return stages_of(_per_day(comments, tz))


def stages_of(daily: DataFrame) -> DataFrame:
    # One value; the subquery reads the same exchanged day counts again.
    peak = daily.agg(F.max_by("date", F.struct("count", -F.unix_date("date")))).scalar()
    stage = F.when(F.col("date") < peak, "onset").when(F.col("date") == peak, "climax").otherwise("calm")
    return daily.select("date", "count", stage.alias("stage")).orderBy("date")


# --- events of several waves ----------------------------------------------------


def event_waves(comments: DataFrame, ratio: float = 2.0, price: float = 1.0, tz: str | None = None) -> DataFrame:
    """``date, count, wave, stage`` of every day from the first to the last: see ``waves_of``."""
    return waves_of(_per_day(comments, tz), ratio, price)


def _paths(days: Column, low: Column, high: Column, up: Column) -> Column:
    """The cheapest states of ``days``: 0 usual, 1 busy.  All costs are whole thousandths, ties keep the state."""

    def cost(rate: Column, day: Column) -> Column:
        return F.round(1000 * (rate - day["count"] * F.ln(rate))).cast("bigint")

    def step(state: Column, day: Column) -> Column:
        usual, busy, climb = state["usual"], state["busy"], state["usual"] + up
        before = F.struct((busy < usual).cast("int").alias("usual"), (busy <= climb).cast("int").alias("busy"))
        return F.struct((F.least(usual, busy) + cost(low, day)).alias("usual"), (F.least(climb, busy) + cost(high, day)).alias("busy"),
                        F.concat(state["ways"], F.array(before)).alias("ways"))

    def back(state: Column, way: Column) -> Column:
        return F.struct(F.when(state["at"] == 1, way["busy"]).otherwise(way["usual"]).alias("at"),
                        F.concat(F.array(state["at"]), state["path"]).alias("path"))

    start = F.struct(F.lit(0).cast("bigint").alias("usual"), up.alias("busy"),
                     F.array().cast("array<struct<usual:int,busy:int>>").alias("ways"))
    ends = F.aggregate(days, start, step, lambda state: F.struct(
        (state["busy"] < state["usual"]).cast("int").alias("at"), F.reverse(state["ways"]).alias("ways")))
    return F.aggregate(ends["ways"], F.struct(ends["at"].alias("at"), F.array().cast("array<int>").alias("path")), back,
                       lambda state: state["path"])


def waves_of(daily: DataFrame, ratio: float = 2.0, price: float = 1.0) -> DataFrame:
    """Waves of ``daily(date, count)`` by an automaton of two states, days without comments included.

    A usual day has the mean count, a busy one ``ratio`` times it (both as Poisson rates); becoming busy costs
    ``price * ln(days)``.  Runs of busy days on the cheapest path are waves, numbered from 1.  Stages: onset before
    a wave's peak day (the earliest of equal ones), climax on it, decline after it, and calm without a wave.
    """
    calendar = daily.agg(F.min("date").alias("first"), F.max("date").alias("last")).select(
        F.explode(F.sequence("first", "last")).alias("date"))
    filled = calendar.join(daily, "date", "left").select("date", F.coalesce("count", F.lit(0)).alias("count"))
    # One row a day of the event: its path is found in one row.
    listed = filled.agg(F.sort_array(F.collect_list(F.struct("date", "count"))).alias("days"), F.avg("count").alias("low"))
    up = F.round(1000 * price * F.ln(F.size("days"))).cast("bigint")
    found = listed.select("days", _paths(F.col("days"), F.col("low"), ratio * F.col("low"), up).alias("path"))
    states = found.select(F.inline(F.arrays_zip("days", "path"))).select("days.*", F.col("path").alias("busy"))
    ordered = Window.orderBy("date")
    fresh = (F.col("busy") == 1) & (F.lag("busy", 1, 0).over(ordered) == 0)
    numbered = states.withColumn("fresh", fresh.cast("int")).select(
        "date", "count", F.when(F.col("busy") == 1, F.sum("fresh").over(ordered)).cast("int").alias("wave"))
    peak = F.max_by("date", F.struct("count", -F.unix_date("date"))).over(Window.partitionBy("wave"))
    stage = (F.when(F.col("wave").isNull(), "calm").when(F.col("date") < peak, "onset")
             .when(F.col("date") == peak, "climax").otherwise("decline"))
    return numbered.select("date", "count", "wave", stage.alias("stage")).orderBy("date")


def ip_location_counts(comments: DataFrame) -> DataFrame:
    """``ip_location, count``, most first."""
    return comments.groupBy("ip_location").count().orderBy(F.desc("count"), "ip_location")


def province_post_counts(
    comments: DataFrame, aliases: Mapping[str, str] = PROVINCE_ALIASES
) -> DataFrame:
    """``name, value``: comments per place under the names used on the map."""
    return provinces_of(comments.groupBy("ip_location").count(), aliases)


def provinces_of(places: DataFrame, aliases: Mapping[str, str] = PROVINCE_ALIASES) -> DataFrame:
    named = places.select("ip_location", "count").replace(dict(aliases), subset=["ip_location"])
    return (
        named.groupBy(F.col("ip_location").alias("name")).agg(F.sum("count").alias("value"))
        .orderBy(F.desc("value"), "name")
    )


def gender_ratio(comments: DataFrame) -> DataFrame:
    """``gender, count, share`` of all comments."""
    return shares_of(comments.groupBy("gender").count())


def shares_of(counts: DataFrame) -> DataFrame:
    whole = counts.agg(F.sum("count")).scalar()
    return counts.select("gender", "count", F.round(F.col("count") / whole, 4).alias("share"))


def posts_per_user_by_gender(comments: DataFrame) -> DataFrame:
    """``gender, avg_posts``: comments per commenting user, NULL where no user is known."""
    posts = F.try_divide(F.count("user_id"), F.countDistinct("user_id"))
    return comments.groupBy("gender").agg(F.round(posts, 4).alias("avg_posts"))
