import datetime

import pytest
from pyspark.sql import functions as F

from hearsay.operators.spool import spool
from hearsay.plans import interaction

DAYS = [datetime.datetime(2024, 5, d) for d in (1, 2, 3)]


@pytest.fixture(scope="module")
def comments(spark):
    """60,000 comments, two thirds of them at one place; some without a time or likes."""
    rows = spark.range(60_000)
    place = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 7))
    mixed = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    return rows.select(
        F.when(F.col("id") % 100 != 0, F.element_at(F.array(*map(F.lit, DAYS)), (F.col("id") % 3 + 1).cast("int"))).alias("created_at"),
        place.alias("ip_location"), F.when(F.col("id") % 50 != 1, mixed).alias("likes"),
        (mixed % 10).alias("comments"), F.lit(None).cast("int").alias("shares"))


@pytest.mark.parametrize("by", [[], ["ip_location"], ["date"], ["date", "ip_location"]])
def test_merged_sketches_keep_the_rank_error(comments, by):
    stored = spool(interaction.sketches(comments, rank_error=0.01), "sketches")
    dated = comments.select("*", F.to_date("created_at").alias("date")).filter("date IS NOT NULL")
    p = 0.9
    marks = interaction.percentiles_of_sketches(stored, p, by=by)
    values = dated.unpivot(list(by), ["likes", "comments", "shares"], "metric", "number").filter("number IS NOT NULL")
    ranked = values.join(marks, [*by, "metric"]).groupBy(*by, "metric", "n").agg(
        F.count("*").alias("size"), F.avg((F.col("number") < F.col("value")).cast("int")).alias("below"),
        F.avg((F.col("number") <= F.col("value")).cast("int")).alias("up_to"))
    rows = ranked.collect()
    assert {r.metric for r in rows} == {"likes", "comments"}
    for r in rows:
        assert r.n == r["size"]
        assert r.below <= p + 0.02 and r.up_to >= p - 0.02  # 0.01 holds in 99 of 100 cases only


def test_small_groups_are_exact(spark):
    rows = [(DAYS[0], "a", n, n % 5, 0) for n in range(1, 101)]
    comments = spark.createDataFrame(rows, "created_at TIMESTAMP, ip_location STRING, likes INT, comments INT, shares INT")
    got = {r.metric: (r.n, r.value) for r in interaction.percentiles_of_sketches(interaction.sketches(comments), 0.5).collect()}
    assert got["likes"] == (100, 50) and got["shares"] == (100, 0)


def test_size_follows_the_error():
    assert interaction.sketch_size(0.0133) == pytest.approx(303, abs=3)
    assert interaction.sketch_size(0.005) > interaction.sketch_size(0.01) > interaction.sketch_size(0.1)
    assert interaction.sketch_size(1.0) == 8


def test_sketches_of_no_comments(comments):
    assert interaction.percentiles_of_sketches(interaction.sketches(comments.limit(0))).count() == 0
