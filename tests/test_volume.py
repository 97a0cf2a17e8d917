import datetime

from pyspark.sql import functions as F

from hearsay.operators.clean import to_analysis
from hearsay.plans import interaction, opinion, volume

DAY = datetime.date


def comments(spark, *rows):
    """Rows of (created_at text, user, gender, place, likes, comments, shares)."""
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "comment_id INT, created_at STRING, user_id STRING, gender STRING, ip_location STRING, "
        "likes STRING, comments STRING, shares STRING",
    )
    return to_analysis(df)


def at(spark, *times):
    return comments(spark, *[(t, "u", "f", "北京", "1", "1", "1") for t in times])


def test_hours_and_days_follow_the_zone(spark):
    df = at(spark, "2024-01-02 03:04:05+08:00", "2024-01-02 23:30:00+00:00", "not a time")
    assert [tuple(r) for r in volume.posts_per_hour(df).collect()] == [(19, 1), (23, 1)]
    assert [tuple(r) for r in volume.posts_per_hour(df, "Asia/Shanghai").collect()] == [(3, 1), (7, 1)]
    assert [tuple(r) for r in volume.posts_per_day(df).collect()] == [(DAY(2024, 1, 1), 1), (DAY(2024, 1, 2), 1)]
    assert [tuple(r) for r in volume.posts_per_day(df, "Asia/Shanghai").collect()] == [
        (DAY(2024, 1, 2), 1), (DAY(2024, 1, 3), 1)
    ]


def test_days_are_ordered_as_dates(spark):
    days = [r["date"] for r in volume.posts_per_day(at(
        spark, "2024-10-02 00:00:00", "2024-9-30 00:00:00", "2024-10-10 00:00:00")).collect()]
    assert days == [DAY(2024, 9, 30), DAY(2024, 10, 2), DAY(2024, 10, 10)]


def test_the_earlier_of_equal_peaks_wins(spark):
    times = ["2024-01-01 01:00:00", "2024-01-02 01:00:00", "2024-01-02 02:00:00",
             "2024-01-03 01:00:00", "2024-01-03 02:00:00", "2024-01-04 01:00:00"]
    df = at(spark, *times)
    assert [tuple(r) for r in volume.event_peak(df).collect()] == [(DAY(2024, 1, 2), 2)]
    stages = [r["stage"] for r in volume.event_stages(df).orderBy("date").collect()]
    assert stages == ["onset", "climax", "calm", "calm"]


def test_no_comments_have_no_peak(spark):
    assert volume.event_peak(at(spark)).count() == volume.event_stages(at(spark)).count() == 0


def test_places_get_the_names_of_the_map(spark):
    rows = [("2024-01-01 00:00:00", "u", "f", place, "1", "1", "1")
            for place in ["中国台湾", "台湾", "中国香港", "中国澳门", "北京"]]
    named = {r["name"]: r["value"] for r in volume.province_post_counts(comments(spark, *rows)).collect()}
    assert named == {"台湾": 2, "香港": 1, "澳门": 1, "北京": 1}
    counted = volume.ip_location_counts(comments(spark, *rows, rows[-1])).collect()
    assert tuple(counted[0]) == ("北京", 2) and len(counted) == 5


def gendered(spark):
    time = "2024-01-01 00:00:00"
    return comments(
        spark, (time, "a", "f", "x", "1", "2", "3"), (time, "a", "f", "x", "2", "2", "3"),
        (time, "b", "f", "y", "bad", "2", "3"), (time, "c", "m", "y", "10", "0", "0"),
    )


def test_gender_questions(spark):
    df = gendered(spark)
    assert {tuple(r) for r in volume.gender_ratio(df).collect()} == {("f", 3, 0.75), ("m", 1, 0.25)}
    assert {tuple(r) for r in volume.posts_per_user_by_gender(df).collect()} == {("f", 1.5), ("m", 1.0)}
    assert {tuple(r) for r in interaction.interaction_per_gender(df).collect()} == {
        ("f", 1.5, 2.0, 3.0), ("m", 10.0, 0.0, 0.0)
    }


def test_leading_users_and_shares(spark):
    df = gendered(spark)
    users = [tuple(r) for r in interaction.top_users(df, 2).collect()]
    assert users == [("a", 13), ("c", 10)]
    assert [tuple(r) for r in interaction.shares_by_location(df).collect()] == [("x", 6), ("y", 3)]
    assert interaction.extreme_count(df, threshold=1).first()["count"] == 2


def test_sentiment_totals(spark):
    df = gendered(spark).withColumn(
        "sentiment", F.when(F.col("comment_id") == 0, "positive").otherwise("negative")
    )
    assert {tuple(r) for r in opinion.sentiment_counts(df).collect()} == {("positive", 1), ("negative", 3)}
    assert [tuple(r) for r in opinion.sentiment_counts(df, 5).collect()] == [("negative", 1)]
    assert {tuple(r) for r in opinion.sentiment_by(df, "gender").collect()} == {("f", 1, 2, 0), ("m", 0, 1, 0)}
    assert [tuple(r) for r in opinion.sentiment_over_time(df).collect()] == [(DAY(2024, 1, 1), 1, 3, 0)]
