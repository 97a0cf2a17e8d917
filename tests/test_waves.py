import datetime
import itertools
import math

from pyspark.sql import functions as F

from hearsay.plans import volume

START = datetime.date(2024, 3, 1)


def _daily(spark, counts):
    rows = [(START + datetime.timedelta(days=i), n) for i, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "date DATE, count BIGINT")


def _cheapest(counts, ratio, price):
    """The least cost of all paths, and what a path costs."""
    low = sum(counts) / len(counts)
    up = round(1000 * price * math.log(len(counts)))

    def cost(path):
        rates = [low, ratio * low]
        total = sum(round(1000 * (rates[s] - n * math.log(rates[s]))) for s, n in zip(path, counts))
        return total + up * sum(a < b for a, b in zip((0, *path), path))

    return min(map(cost, itertools.product((0, 1), repeat=len(counts)))), cost


def test_two_waves_have_stages_of_their_own(spark):
    counts = [3, 2, 40, 60, 30, 2, 0, 3, 2, 45, 40, 3]
    rows = volume.waves_of(_daily(spark, counts)).collect()
    assert [r["count"] for r in rows] == counts
    assert [r.wave for r in rows] == [None, None, 1, 1, 1, None, None, None, None, 2, 2, None]
    assert [r.stage for r in rows][2:5] == ["onset", "climax", "decline"]
    assert [r.stage for r in rows][8:] == ["calm", "climax", "decline", "calm"]


def test_paths_are_the_cheapest_of_all(spark):
    waves = [5, 9, 9, 1, 0, 12, 3, 8, 8, 1]
    for counts, ratio, price in ((waves, 2.0, 1.0), (waves, 1.5, 0.2), ([1, 1, 1, 1], 2.0, 1.0), ([7], 2.0, 1.0),
                                 ([1, 40, 1, 40, 1, 1, 40, 40], 3.0, 0.0)):
        rows = volume.waves_of(_daily(spark, counts), ratio, price).collect()
        least, cost = _cheapest(counts, ratio, price)
        assert cost([int(r.wave is not None) for r in rows]) == least


def test_events_without_comments_have_no_waves(spark):
    none = spark.createDataFrame([], "created_at TIMESTAMP, likes INT")
    assert volume.event_waves(none).collect() == []
    unread = spark.range(3).select(F.lit(None).cast("timestamp").alias("created_at"))
    assert volume.event_waves(unread).collect() == []
