import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hearsay.operators import ranks
from hearsay.plans import interaction


def value(spark, numbers, rule):
    df = spark.createDataFrame([(n,) for n in numbers], "likes INT")
    rows = ranks.values_at(df, ["likes"], rule).collect()
    return rows[0]["value"] if rows else None


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_percentile_over_many_buckets(spark, p):
    rng = random.Random(1)
    numbers = [rng.randrange(-(2**31), 2**31) for _ in range(500)] + [7] * 250
    assert value(spark, numbers, ranks.interpolated(p)) == pytest.approx(np.percentile(numbers, p * 100))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    numbers=st.lists(st.integers(-70_000, 200_000), min_size=1, max_size=40),
    p=st.sampled_from([0.1, 0.25, 0.5, 0.75, 0.99]),
)
def test_percentile_of_any_numbers(spark, numbers, p):
    assert value(spark, numbers, ranks.interpolated(p)) == pytest.approx(np.percentile(numbers, p * 100))


def test_nulls_do_not_count_and_nothing_gives_nothing(spark):
    assert value(spark, [None, 1, None, 3], ranks.interpolated(0.5)) == 2.0
    assert value(spark, [None], ranks.interpolated(0.5)) is None


def test_one_value_holds_most_rows(spark):
    assert value(spark, [5] * 1000 + [9], ranks.interpolated(0.99)) == 5.0


def test_value_at_a_place(spark):
    values = [3, -5, 2**40, -(2**50), 7, 7, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "n BIGINT")
    assert [ranks.value_at(df, "n", i) for i in range(7)] == sorted(values)
    assert ranks.value_at(df, "n", 7) is None


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(i, 2 * i, None) for i in range(101)], "likes INT, comments INT, shares INT")
    got = {r["metric"]: r["p99"] for r in interaction.percentiles(df).collect()}
    assert got == {"likes": 99.0, "comments": 198.0}
    estimate = {r["metric"]: r["p99"] for r in interaction.percentiles(df, ["likes"], exact=False).collect()}
    assert estimate["likes"] in (99.0, 100.0)


def _comments(spark, rows):
    return spark.createDataFrame(rows, "comment_id BIGINT, likes INT, comments INT, shares INT")


def _top(rows, share):
    rate = lambda r: r[3] / sum(r[1:]) if sum(r[1:]) else 0.0
    ranked = sorted(rows, key=lambda r: (-rate(r), r[0]))
    return sorted(r[0] for r in ranked[:max(1, int(share * len(rows)))])


@pytest.mark.parametrize("rows", [
    [(i, 9, 0, 1) for i in range(17)] + [(100, 0, 0, 5), (101, 1, 0, 1), (102, 1, 0, 1)],
    [(i, 1, 1, 0) for i in range(1000)],
    [(i, 1, 1, 0) for i in range(95)] + [(200 + i, i, 1, i) for i in range(5)],
    [(1, 0, 0, 1)],
    [(i, 1_000_000 + i, 0, 333_333) for i in range(40)],  # equal in millionths
])
def test_high_conversion_is_exactly_the_top_share(spark, rows):
    high = interaction.high_conversion(_comments(spark, rows), share=0.1)
    assert sorted(r["comment_id"] for r in high.collect()) == _top(rows, 0.1)


def test_high_conversion_of_ids_that_are_texts(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("comment_id"), F.lit(1).alias("likes"),
                                  F.lit(1).alias("comments"), F.lit(0).alias("shares"))
    assert interaction.high_conversion(rows, share=0.1).count() == 5


def test_high_conversion_of_no_comments_is_empty(spark):
    assert interaction.high_conversion(_comments(spark, []), 0.1).count() == 0


def test_conversion_without_interaction_or_with_nulls_is_zero(spark):
    rows = [(1, 0, 0, 0), (2, None, 1, 1), (3, 1, 0, 1)]
    rates = interaction.top_conversion(_comments(spark, rows)).collect()
    assert [tuple(r) for r in rates] == [(3, 0.5), (1, 0.0), (2, 0.0)]
    assert interaction.average_share_conversion(_comments(spark, rows)).first()[0] == 0.1667


def test_average_of_no_comments_is_null(spark):
    assert interaction.average_share_conversion(_comments(spark, [])).first()[0] is None


def test_totals_do_not_overflow(spark):
    big = 2**31 - 1
    rows = _comments(spark, [(1, big, big, big)])
    assert interaction.top_conversion(rows).first()["share_conversion_rate"] == 0.333333
