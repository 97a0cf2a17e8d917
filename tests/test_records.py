"""CSV with line breaks inside values, read by splits, against Spark's own multi-line reader."""

import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from hearsay.operators.spool import portions, shared_folder, spool
from hearsay.sources import records, tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("n", T.LongType())])
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes."""
    spark.conf.set(SPLIT, "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for key in (SPLIT, "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def _value(draw):
    pieces = ['""', "\n", ",", "a", "é", " ", "\r\n", "text", "\n\n", '"",""', "5"]
    kind = draw.random()
    if kind < 0.3:
        return "".join(draw.choice("abc 5") for _ in range(draw.randrange(12)))
    if kind < 0.4:
        return draw.choice(['5" wide', 'a"b"c', "it's", 'x""', ' "y" '])
    return '"' + "".join(draw.choice(pieces) for _ in range(draw.randrange(40))) + '"'


def _file(path, seed, rows=60, tail=""):
    draw = random.Random(seed)
    body = "id,body,n\n" + "".join(f"{i},{_value(draw)},{draw.randrange(99)}\n" for i in range(rows)) + tail
    path.write_bytes(body.encode())


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _own(spark, path):
    rows = _rows(spark.read.options(**tables.CSV_OPTIONS).option("multiLine", "true").schema(SCHEMA).csv(str(path)))
    # The end of the last line belongs to a value that is not closed there, and not here.
    return sorted(((i, body.removesuffix("\n") if i == 7 and n is None else body, n) for i, body, n in rows), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_rows_equal_the_multi_line_reader(spark, splits, tmp_path, seed):
    for k in range(3):
        _file(tmp_path / f"{k}.csv", 10 * seed + k, rows=[60, 1, 0][k], tail=["", "7,\"no end\n8,of it,3\n", ""][k])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    assert _rows(records.read_spread(spark, str(tmp_path), SCHEMA, tables.CSV_OPTIONS)) == _own(spark, tmp_path)


def test_values_over_several_splits(spark, splits, tmp_path):
    long = "line of a long value\n" * 100
    (tmp_path / "a.csv").write_text(f'id,body,n\n1,"{long}",2\n3,b,4\n5,"{long}{long}"" quoted ""{long}",6\n')
    monkey = records.MOST_SPLITS
    records.MOST_SPLITS = 100
    try:
        assert _rows(records.read_spread(spark, str(tmp_path), SCHEMA, tables.CSV_OPTIONS)) == _own(spark, tmp_path)
    finally:
        records.MOST_SPLITS = monkey
    with pytest.raises(PySparkException, match="not closed"):
        records.read_spread(spark, str(tmp_path), SCHEMA, tables.CSV_OPTIONS).collect()


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body,n\n1,a,2\n")
    (tmp_path / "b.csv").write_text("id,n,body\n1,2,a\n")
    with pytest.raises(PySparkException, match="another header"):
        records.read_spread(spark, str(tmp_path), SCHEMA, tables.CSV_OPTIONS).collect()


def test_large_files_are_read_by_many_tasks(spark, splits, tmp_path):
    _file(tmp_path / "a.csv", 3, rows=200)
    df = tables.read_csv(spark, str(tmp_path), SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "Python" not in plan
    assert _rows(df) == _own(spark, tmp_path)
    spark.conf.unset(SPLIT)
    assert "Scan csv" in tables.read_csv(spark, str(tmp_path), SCHEMA)._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_shuffled_but_over_the_ends_of_splits(spark, splits, tmp_path):
    _file(tmp_path / "a.csv", 5, rows=200)
    df = records.read_spread(spark, str(tmp_path), SCHEMA, tables.CSV_OPTIONS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    pieces = [line for line in plan.splitlines() if "collect_list" in line]
    assert pieces and _rows(df) == _own(spark, tmp_path)


def test_compressed_files_are_read_whole(spark, splits, tmp_path):
    rows = [(i, "line\n" * (i % 7) + '"', i) for i in range(300)]
    tables.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "z"), compression="gzip")
    assert list((tmp_path / "z").glob("*.csv.gz")) and not records.has_large_file(spark, str(tmp_path / "z"))
    assert _rows(tables.read_csv(spark, str(tmp_path / "z"), SCHEMA)) == sorted(rows, key=repr)


@pytest.mark.parametrize("least, most, n", [(1, 100, 5), (1, 2, 2), (10**9, 100, 1), (250, 100, 3)])
def test_portions_hold_all_rows_once(spark, least, most, n):
    stored = spool(spark.range(0, 500, 1, 5).withColumn("size", F.lit(1)), "rows")  # five files of 100
    parts = list(portions(stored, F.col("size"), least, most))
    assert len(parts) <= n and sorted(r.id for part in parts for r in part.collect()) == list(range(500))
    assert least > 1 or len(parts) == n
    assert all(part.count() >= min(least, 500) for part in parts[:-1])


def test_portions_of_nothing(spark):
    none = spool(spark.range(0).withColumn("size", F.lit(None).cast("long")), "rows")
    assert [part.count() for part in portions(none, F.col("size"), 1)] == [0]


def test_csv_is_there_in_portions_only(spark, sf_dir, monkeypatch):
    """Plain CSV of all texts is never there at once, and none of it stays."""
    folder = Path(shared_folder(spark).removeprefix("file:")) / "hearsay"
    csv = lambda: {p for p in folder.glob("csv-*") if p not in before}
    before, seen, write = set(folder.glob("csv-*")), [], tables.write_csv
    whole = sorted(entry.csv_spread(spark, sf_dir).collect(), key=repr)
    assert not csv()

    def watched(df, path):
        write(df, path)
        seen.append(sum(f.stat().st_size for p in csv() for f in p.glob("*.csv")))

    monkeypatch.setattr(tables, "write_csv", watched)
    monkeypatch.setattr(entry, "CSV_BYTES", 1)
    several = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # files
    for key, value in several.items():
        spark.conf.set(key, value)
    try:
        df = entry.csv_spread(spark, sf_dir)
    finally:
        for key in several:
            spark.conf.unset(key)
    assert len(seen) > 2 and max(seen) < 0.6 * sum(seen) and not csv()
    assert sorted(df.collect(), key=repr) == whole and len({r.comment_id for r in whole}) == len(whole)
