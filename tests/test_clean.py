import datetime

import pytest

from hearsay.operators import clean
from hearsay.schemas import ANALYSIS_NAMES, REPLY_SCHEMA, STORED_NAMES, TOP_LEVEL_SCHEMA

TIME = "2024-01-02 03:04:05+08:00"


def top_level(spark, *rows):
    names = TOP_LEVEL_SCHEMA.names
    base = dict.fromkeys(names, "x") | {
        "create_date_time": TIME, "comments_count": "1", "liked_count": "2", "shared_count": "3",
    }
    return spark.createDataFrame([tuple((base | row)[n] for n in names) for row in rows], TOP_LEVEL_SCHEMA)


def replies(spark, *rows):
    names = REPLY_SCHEMA.names
    base = dict.fromkeys(names, "y") | {
        "create_date_time": TIME, "sub_comment_count": "4", "comment_like_count": "5",
    }
    return spark.createDataFrame([tuple((base | row)[n] for n in names) for row in rows], REPLY_SCHEMA)


def test_levels_are_merged_in_the_top_level_layout(spark):
    merged = clean.clean_merge(top_level(spark, {}), replies(spark, {}), keep_ids=False)
    assert set(merged.columns) == set(STORED_NAMES)
    rows = {r["content"]: r.asDict() for r in merged.collect()}
    assert (rows["x"]["liked_count"], rows["x"]["shared_count"]) == ("2", "3")
    assert (rows["y"]["liked_count"], rows["y"]["comments_count"], rows["y"]["shared_count"]) == ("5", "4", "0")


def test_ids_are_kept_on_request_and_may_be_null(spark):
    merged = clean.clean_merge(top_level(spark, {"user_id": None}), replies(spark, {}))
    assert {"comment_id", "user_id"} <= set(merged.columns) and "nickname" not in merged.columns
    assert merged.count() == 2


def test_rows_with_a_null_are_dropped_and_duplicates_stay(spark):
    first = top_level(spark, {}, {}, {"gender": None}, {"content": None})
    second = replies(spark, {}, {"ip_location": None})
    assert clean.clean_merge(first, second).count() == 3
    audit = {r["stage"]: tuple(r)[1:] for r in clean.null_drop_audit(first, second).collect()}
    assert audit == {"level1": (4, 2, 2), "level2": (2, 1, 1), "merged": (3, 3, 0)}


def test_a_column_missing_in_replies_drops_all_replies(spark):
    first, second = top_level(spark, {}), replies(spark, {}, {}).drop("gender")
    assert [r["content"] for r in clean.clean_merge(first, second).collect()] == ["x"]
    audit = {r["stage"]: tuple(r)[1:] for r in clean.null_drop_audit(first, second).collect()}
    assert audit == {"level1": (1, 1, 0), "level2": (2, 2, 0), "merged": (3, 1, 2)}


def test_empty_tables(spark):
    audit = {r["stage"]: tuple(r)[1:] for r in clean.null_drop_audit(top_level(spark), replies(spark)).collect()}
    assert audit == dict.fromkeys(["level1", "level2", "merged"], (0, 0, 0))


def test_stored_and_analysis_names(spark):
    stored = clean.to_stored(clean.clean_merge(top_level(spark, {}), replies(spark), keep_ids=False))
    assert set(stored.columns) == set(STORED_NAMES.values())
    typed = clean.to_analysis(stored)
    assert set(typed.columns) == set(ANALYSIS_NAMES.values())
    row = typed.first()
    assert (row["likes"], row["comments"], row["shares"]) == (2, 1, 3)
    # The session runs in UTC.
    assert row["created_at"] == datetime.datetime(2024, 1, 1, 19, 4, 5)


def test_values_that_do_not_parse_become_null(spark):
    rows = top_level(spark, {"liked_count": "1.2万", "create_date_time": "yesterday"})
    typed = clean.to_analysis(clean.to_stored(clean.clean_merge(rows, replies(spark))))
    row = typed.first()
    assert row["likes"] is None and row["created_at"] is None and row["shares"] == 3


def test_plain_timestamps_are_accepted(spark):
    rows = top_level(spark, {"create_date_time": "2024-01-02 03:04:05"})
    typed = clean.to_analysis(clean.to_stored(clean.clean_merge(rows, replies(spark))))
    assert typed.first()["created_at"] == datetime.datetime(2024, 1, 2, 3, 4, 5)


def test_dropping_columns_that_are_not_there(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, user_id INT")
    assert clean.drop_columns(df, ["user_id", "nickname"]).columns == ["a"]
    assert clean.drop_columns(df, ["user_id"], keep=["user_id"]).columns == ["a", "user_id"]
    assert clean.missing_columns(df, ["user_id", "nickname"]) == ["nickname"]


def test_align_adds_typed_nulls_in_order(spark):
    like = spark.createDataFrame([(1, "a", 2.0)], "x INT, y STRING, z DOUBLE")
    df = spark.createDataFrame([("b", 5)], "y STRING, x INT")
    aligned = clean.align(df, like.columns, like)
    assert aligned.dtypes == like.dtypes and tuple(aligned.first()) == (5, "b", None)


def test_profile_counts_values(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a INT, b STRING")
    assert {tuple(r) for r in clean.profile(df).collect()} == {("a", 2, 2), ("b", 2, 1)}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_preview_is_ordered(spark, n):
    df = spark.createDataFrame([(3,), (1,), (2,)], "a INT")
    assert [r["a"] for r in clean.preview(df, "a", n).collect()] == [1, 2, 3][:n]
