"""Connected components of an edge table, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for all nodes of ``edges(u, v)``; a component's name is its least node.

    In every round a node takes the least label near it and then the label of that label's
    node, so labels travel ever further; each round starts from a table in the shared
    folder, and the last one changes nothing.  Labels meet in sums by key, which start on
    the map side, and in joins, whose hot keys can be split over tasks.
    """
    ways = written(edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select("v", "u")).distinct(), "edges")
    labels = ways.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component"))
    labels = written(labels, "labels")
    for _ in range(rounds):
        near = ways.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
        least = labels.select("node", "component", F.col("component").alias("old")).unionByName(
            near.withColumn("old", F.lit(None).cast(labels.schema["component"].dataType))).groupBy("node").agg(
            F.min("component").alias("component"), F.max("old").alias("old"))
        far = labels.select(F.col("node").alias("n"), F.col("component").alias("further"))
        labels = written(least.join(far, F.col("component") == F.col("n")).select(
            "node", F.least("component", "further").alias("component"), "old"), "labels")
        if labels.filter("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError("components did not settle")
