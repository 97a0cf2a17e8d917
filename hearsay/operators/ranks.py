"""Exact order statistics of integer columns without sorting the table.

Values are counted (combined on the map side), then found 16 bits at a time: the
high bits of a 64-bit value name one of at most 65,536 buckets, the next 16 bits one
of as many in that bucket, and so on.  So no window ever sees more than 65,536 rows
of one column, whatever the size or skew of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# total number of values -> [(0-based rank, weight), ...]
RankRule = Callable[[Column], Sequence[tuple[Column, Column]]]


def interpolated(p: float) -> RankRule:
    """Linear interpolation between the two closest ranks."""

    def rule(total: Column):
        position = (total - 1) * F.lit(float(p))
        part = position - F.floor(position)
        return [(F.floor(position), 1 - part), (F.ceil(position), part)]

    return rule


def nth_least(place: Column) -> RankRule:
    """The value at a 0-based place from below."""
    return lambda total: [(place, F.lit(1.0))]


def counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``metric, number, n``: how often each value of the columns occurs, NULL aside."""
    typed = df.select(*[F.col(c).cast("bigint").alias(c) for c in columns])
    return (
        typed.unpivot([], list(columns), "metric", "number")
        .filter(F.col("number").isNotNull())
        .groupBy("metric", "number")
        .agg(F.count("*").alias("n"))
    )


def found(counts: DataFrame, rule: RankRule) -> DataFrame:
    """``metric, number, weight`` at the ranks given by ``rule``, from ``counted`` values."""
    wanted = [
        F.struct(F.lit(i).alias("which"), rank.cast("bigint").alias("rank"), weight.alias("weight"))
        for i, (rank, weight) in enumerate(rule(F.col("total")))
    ]
    totals = counts.groupBy("metric").agg(F.sum("n").alias("total"))
    # One row per metric and wanted rank; ``rank`` counts on from the start of the bucket.
    targets = totals.select("metric", F.inline(F.array(*wanted)))
    for shift in (48, 32, 16, 0):
        bucket = F.shiftright("number", shift)
        at = ["metric"]
        part = counts
        if shift < 48:
            part = counts.withColumn("within", F.shiftright("number", shift + 16))
            at.append("within")
        sizes = (
            part.join(F.broadcast(targets), at)
            .groupBy("metric", "which", "rank", "weight", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
            .withColumn("ends", F.sum("n").over(Window.partitionBy("metric", "which").orderBy("bucket")))
        )
        targets = sizes.filter((F.col("rank") < F.col("ends")) & (F.col("rank") >= F.col("ends") - F.col("n"))).select(
            "metric", "which", (F.col("rank") - F.col("ends") + F.col("n")).alias("rank"), "weight",
            F.col("bucket").alias("within"))
    return targets.select("metric", F.col("within").alias("number"), "weight")


def values_in(counts: DataFrame, rule: RankRule) -> DataFrame:
    """``values_at`` from ``counted`` values."""
    return found(counts, rule).groupBy("metric").agg(F.sum(F.col("number") * F.col("weight")).alias("value"))


def values_at(df: DataFrame, columns: Sequence[str], rule: RankRule) -> DataFrame:
    """``metric, value``: weighted sum of the values at the ranks given by ``rule``.

    ``columns`` are whole numbers; NULLs do not count.  A column without values, or
    a rank outside of them, gives no row.
    """
    return values_in(counted(df, columns), rule)


def value_in(counts: DataFrame, place: int) -> int | None:
    """The value at one 0-based place of the ``counted`` values of one column; None outside."""
    return found(counts, nth_least(F.lit(place))).agg(F.max("number")).first()[0]


def value_at(df: DataFrame, column: str, place: int) -> int | None:
    """The value at one 0-based place of an integer column; None outside."""
    return value_in(counted(df, [column]), place)
