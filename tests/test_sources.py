import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators import spool
from hearsay.schemas import REPLY_SCHEMA, TOP_LEVEL_SCHEMA
from hearsay.sources import json_lines, results, tables

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def save(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def pairs(df):
    return sorted((tuple(r) for r in df.select("a", "b").collect()), key=repr)


# --- CSV ----------------------------------------------------------------------


def test_csv_keeps_line_breaks_quotes_and_blanks(spark, tmp_path):
    text = 'review,label\n"two\nlines, ""quoted""",1\n" padded ",0\n"back\\slash",1\n'
    rows = tables.read_corpus_csv(spark, save(tmp_path, "c.csv", text)).collect()
    assert [tuple(r) for r in rows] == [('two\nlines, "quoted"', 1), (" padded ", 0), ("back\\slash", 1)]


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    text = "label,extra,review\n1,z,fine\n"
    path = save(tmp_path, "c.csv", text)
    assert tuple(tables.read_corpus_csv(spark, path).first()) == ("fine", 1)
    raw = tables.read_top_level_csv(spark, save(tmp_path, "t.csv", "liked_count,content,mystery\n1.2万,hi,?\n"))
    assert raw.dtypes == [("liked_count", "string"), ("content", "string"), ("mystery", "string")]
    assert tuple(raw.first()) == ("1.2万", "hi", "?")


def test_csv_without_breaks_can_be_read_line_by_line(spark, tmp_path):
    path = save(tmp_path, "r.csv", "content,gender\na,f\nb,\n")
    rows = tables.read_replies_csv(spark, path, multi_line=False).collect()
    assert [tuple(r) for r in rows] == [("a", "f"), ("b", None)]


def test_csv_written_is_csv_read(spark, tmp_path):
    values = [("a\nb", " x "), ('say "hi"', "1,2"), (None, "z"), ("c\\", "ü")]
    schema = T.StructType([TOP_LEVEL_SCHEMA["content"], TOP_LEVEL_SCHEMA["ip_location"]])
    path = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame(values, schema), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, schema).collect()), key=repr) == sorted(values, key=repr)
    assert set(schema.names) < set(REPLY_SCHEMA.names)


# --- stored table -------------------------------------------------------------


def test_a_stored_table_without_ids_gets_stable_ones(spark, tmp_path):
    df = spark.range(100).select(
        F.lit("2024-01-02 03:04:05+00:00").alias("创建日期时间"), F.col("id").cast("string").alias("内容"),
        F.lit("1").alias("评论数"), F.lit("2").alias("点赞数"), F.lit("3").alias("分享数"),
        F.lit("北京").alias("IP属地"), F.lit("f").alias("性别"),
    )
    path = tables.write_stored(df, str(tmp_path), sub_dir="cleaned", files=3)
    assert path.endswith("/cleaned")
    first = {r["content"]: r["comment_id"] for r in tables.read_stored(spark, path).collect()}
    again = {
        r["content"]: r["comment_id"]
        for r in tables.read_stored(spark, path).select("comment_id", "content").repartition(7).collect()
    }
    assert first == again and len(set(first.values())) == 100
    assert set(tables.read_stored(spark, path).select("row_id").toPandas()["row_id"]) == set(first.values())
    parts = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(parts) == 3
    assert 0 < tables.read_stored(spark, f"{path}/{parts[0]}").count() < 100


def test_writing_replaces_the_stored_table(spark, tmp_path):
    for n in (5, 2):
        tables.write_stored(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


# --- JSON ---------------------------------------------------------------------


def test_json_lines_skip_bad_lines(spark, tmp_path):
    text = '{"a": 1, "b": "x"}\nnot json\n{"a": 2, "b"\n\n{"a": 3, "b": "y", "c": 0}\n'
    assert pairs(json_lines.read_tolerant(spark, save(tmp_path, "l.json", text), SCHEMA)) == [(1, "x"), (3, "y")]


def test_json_counts_without_reading_columns(spark, tmp_path):
    path = save(tmp_path, "l.json", '{"a": 1}\n{"a":\n')
    assert json_lines.read_tolerant(spark, path, SCHEMA).count() == 1


def test_a_field_of_another_type_is_null(spark, tmp_path):
    path = save(tmp_path, "l.json", '{"a": "one", "b": "x"}\n{"a": 2, "b": "y"}\n')
    assert pairs(json_lines.read_tolerant(spark, path, SCHEMA)) == [(2, "y"), (None, "x")]


@pytest.mark.parametrize("indent", [None, 2])
def test_a_document_may_be_one_object(spark, tmp_path, indent):
    path = save(tmp_path, "d.json", json.dumps({"a": 1, "b": "x"}, indent=indent))
    assert pairs(json_lines.read_tolerant(spark, path, SCHEMA)) == [(1, "x")]


def test_a_document_may_be_an_array(spark, tmp_path):
    path = save(tmp_path, "d.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=1))
    rows = json_lines.read_tolerant(spark, path, SCHEMA)
    assert pairs(rows) == [(1, "x"), (2, "y")] and rows.count() == 2


def test_an_array_on_one_line(spark, tmp_path):
    path = save(tmp_path, "d.json", '[{"a": 1}, {"a": 2, "b": "y"}]')
    assert pairs(json_lines.read_tolerant(spark, path, SCHEMA)) == [(1, None), (2, "y")]


@pytest.mark.parametrize("lines", [3, 100])
def test_a_folder_may_mix_documents_and_lines(spark, tmp_path, lines):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "document.json").write_text(json.dumps({"a": 0, "b": "x" * 900}, indent=2))
    (folder / "lines.json").write_text("".join(json.dumps({"a": i}) + "\n" for i in range(1, lines + 1)))
    (folder / "array.json").write_text('[\n{"a": 200},\n{"a": 201}\n]\n')
    (folder / "broken.json").write_text('{"a":\n{"a": 300}\n')
    got = sorted(r["a"] for r in json_lines.read_tolerant(spark, str(folder), SCHEMA).collect())
    assert got == [0, *range(1, lines + 1), 200, 201, 300]


def test_good_lines_after_a_broken_first_line(spark, tmp_path):
    path = save(tmp_path, "l.json", '{"a": 1, "b\n{"a": 2, "b": "y"}\n{"a": 3, "b": "z"}\n')
    assert pairs(json_lines.read_tolerant(spark, path, SCHEMA)) == [(2, "y"), (3, "z")]


@pytest.mark.parametrize("text", ["", "nothing here\nnor here\n", "{\n"])
def test_no_json_at_all_is_an_error(spark, tmp_path, text):
    with pytest.raises(json_lines.NoJsonError):
        json_lines.read_tolerant(spark, save(tmp_path, "n.json", text), SCHEMA)


def test_json_written_is_json_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, 'q"')], SCHEMA)
    path = str(tmp_path / "j")
    for _ in range(2):  # the second write replaces the first
        json_lines.write_json(df, path)
    assert pairs(json_lines.read_tolerant(spark, path, SCHEMA)) == [(1, "x\ny"), (2, 'q"')]


# --- results ------------------------------------------------------------------


def test_results_go_to_one_folder_each(spark, tmp_path):
    written = {"one": spark.range(3).toDF("n"), "two": spark.range(4).toDF("n")}
    paths = results.write_results(written, str(tmp_path))
    assert paths == {name: f"{tmp_path}/{name}" for name in written}
    read = results.read_results(spark, paths, {name: df.schema for name, df in written.items()})
    assert {name: df.count() for name, df in read.items()} == {"one": 3, "two": 4}


def test_a_failing_result_is_not_swallowed(spark, tmp_path):
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        results.write_results({"x": broken}, str(tmp_path))


# --- shared folder ------------------------------------------------------------


class FakeConf:
    def __init__(self, **values):
        self.values = {k.replace("__", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


class FakeSession:
    def __init__(self, **values):
        self.conf = FakeConf(**values)


def test_the_folder_of_the_session_is_used():
    session = FakeSession(spark__checkpoint__dir="hdfs://shared/ck/", spark__master="yarn")
    assert spool.shared_folder(session) == "hdfs://shared/ck"


def test_without_a_named_folder_tables_go_below_the_warehouse():
    session = FakeSession(spark__sql__warehouse__dir="hdfs://warehouse/")
    assert spool.shared_folder(session) == "hdfs://warehouse/shared"


def test_scratch_tables_are_removed(spark):
    with spool.scratch(spark):
        table = spool.spool(spark.range(3), "numbers")
        path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path) and table.count() == 3
    assert not os.path.exists(path)


def test_spooled_tables_start_from_files(spark):
    df = spool.spool(spark.range(10).withColumn("x", F.lit("a")), "numbers")
    assert df.columns == ["id", "x"] and df.count() == 10 and df.inputFiles()


# --- CSV headers ----------------------------------------------------------------


@pytest.mark.parametrize("multi_line", [True, False])
def test_files_with_columns_in_another_order_are_an_error(spark, tmp_path, multi_line):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("review,label\ngood,1\n")
    (folder / "b.csv").write_text("review,label\nbad,0\n")
    rows = tables.read_corpus_csv(spark, str(folder), multi_line).collect()
    assert sorted(map(tuple, rows)) == [("bad", 0), ("good", 1)]
    (folder / "c.csv").write_text("label,review\n0,bad\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_corpus_csv(spark, str(folder), multi_line).collect()


def test_reading_by_line_fails_on_values_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('review,label\n"two\nlines",1\n')
    assert tables.read_corpus_csv(spark, str(tmp_path / "a.csv")).collect() == [("two\nlines", 1)]
    with pytest.raises(tables.UnclosedQuoteError):
        tables.read_corpus_csv(spark, str(tmp_path / "a.csv"), multi_line=False)


def test_counts_beyond_32_bits(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05+00:00", "3000000000")], "`创建日期时间` STRING, `点赞数` STRING").selectExpr(
        "*", "'1' AS `评论数`", "'2' AS `分享数`", "'x' AS `内容`", "'y' AS `IP属地`", "'f' AS `性别`")
    from hearsay.operators.clean import to_analysis
    assert to_analysis(df).first()["likes"] == 3_000_000_000
