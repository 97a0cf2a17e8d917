"""Mixing sources to target weights by systematic sampling.

The documents of a source stand in one line, ordered by size, and each expects
``target / source size`` copies.  Along the prefix sums of these, moved by one random
offset a source, a document is emitted once per whole number crossed.  The line is
ordered by size, so the words taken are near the target and not only the copies.

The place in the line needs no window over a source: rows are dealt by range, so that
a hot source is spread over many tasks, and the rows before a range are counted.
Null and empty texts have size 0; a null source is a source of its own, last in order;
repeated rows are separate rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.tables import WORD, as_text, md5_unit, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
ROWS_PER_RANGE = 250_000


def sized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(key), "source", F.regexp_count(as_text(), F.lit(WORD)).cast("bigint").alias("size")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words dealt by weight, within ``most`` copies.

    Sources fill up in the order of ``cap / weight``.  One row per source, so windows
    over all of them are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    table = F.array(*map(F.lit, weights))
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights)) + 1))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.sum("source_size").over(every) * share)
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    )
    # The level rises while sources fill up and falls behind the first one that does not.
    level = (F.col("pool") - F.col("capped_before")) / F.col("weight_from")
    return (
        ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def mix(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE,
        most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``key, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    return sample(written(sized(docs, key), "sizes"), key, weights, share, most, seed)


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, as often as the mix takes them."""
    # Rows travel whole, in one column, so that names cannot clash.
    rows = docs.select(
        F.col(key).alias("key"), F.col("source"), F.regexp_count(as_text(), F.lit(WORD)).cast("bigint").alias("size"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    taken = sample(rows, "key", **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sample(sizes: DataFrame, key: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
           seed: int = 0) -> DataFrame:
    """As ``mix``, for a ``sizes(key, source, size)`` that reads stored rows, with any further columns."""
    ranges = max(1, sizes.count() // ROWS_PER_RANGE + 1)
    ranges = max(ranges, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last(), "size", key).sortWithinPartitions(
        F.col("source").asc_nulls_last(), "size", key
    )
    # The id holds the range in its high bits and counts the rows of the range in the low ones.
    line = written(line.withColumn("at", F.monotonically_increasing_id()), "line")
    line = line.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        line.groupBy("range", "source").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
        .join(targets(sizes, weights, share, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("range").alias("r"), F.col("source").alias("s"), "offset", "source_size", "target")
    )
    start = md5_unit(F.lit(str(seed)), F.coalesce("source", F.lit("\x00null")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = line.join(offsets, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    return (
        placed.withColumn("place", F.col("at") + F.col("offset"))
        .withColumn("copies", (F.floor(start + (F.col("place") + 1) * rate) - F.floor(start + F.col("place") * rate)).cast("bigint"))
        .withColumn("copies", F.least("copies", F.lit(most).cast("bigint")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("r", "s", "at", "range", "offset", "place")
    )
