"""JSON documents over many lines, read by splits, against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import types as T

from hearsay.sources import json_lines

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.LongType()))])
SPLIT, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture(autouse=True)
def splits(spark):
    spark.conf.set(SPLIT, "400b")
    spark.conf.set(COST, "1b")
    yield
    spark.conf.unset(SPLIT)
    spark.conf.unset(COST)


def _objects(n, seed):
    draw = random.Random(seed)
    pieces = ["{", "}", "[", "]", '"', "\\", "\\\\", "\n", "\t", ",", "é", "\\u0041", " ", "text"]
    return [{"a": i, "s": "".join(draw.choice(pieces) for _ in range(draw.randrange(12))), "l": list(range(draw.randrange(4)))} for i in range(n)]


def _read(spark, path):
    rows = json_lines.read_tolerant(spark, str(path), SCHEMA)
    return sorted((r.a, r.s, r.l) for r in rows.collect())


def _listed(objects):
    return sorted((o["a"], o["s"], o["l"]) for o in objects)


@pytest.mark.parametrize("seed", range(3))
def test_one_array_over_many_lines(spark, tmp_path, seed):
    objects = _objects(80, seed)
    (tmp_path / "a.json").write_text(json.dumps(objects, indent=[2, 0, 4][seed], ensure_ascii=False))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert _read(spark, tmp_path) == _listed(objects)


def test_objects_over_many_lines(spark, tmp_path):
    objects = _objects(60, 7)
    (tmp_path / "a.json").write_text("\n".join(json.dumps(o, indent=2) for o in objects))
    (tmp_path / "b.json").write_text("[]\n")
    assert _read(spark, tmp_path) == _listed(objects)


def test_several_objects_on_a_line_of_a_document(spark, tmp_path):
    objects = _objects(30, 8)
    halves = [", ".join(json.dumps(o) for o in part) for part in (objects[:11], objects[11:])]
    (tmp_path / "a.json").write_text(f"[ {halves[0]},\n {halves[1]}\n]")
    assert _read(spark, tmp_path) == _listed(objects)


def test_lines_of_which_the_first_is_broken(spark, tmp_path):
    objects = _objects(50, 9)
    lines = ['{"a": 1, "s": "no end', *map(json.dumps, objects[:25]), "[[[", *map(json.dumps, objects[25:])]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(objects[i:i + 5]) for i in range(0, 50, 5)))
    assert _read(spark, tmp_path) == _listed(objects + objects)


def test_broken_objects_of_a_document_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1,\n"s": "x"},\n{"a": nothing\n},\n7,\n[8, {"a": 9}],\n{"a": 2, "s":\n"y"}\n]')
    assert [r[0] for r in sorted((r.a, r.s) for r in json_lines.read_tolerant(spark, str(tmp_path), SCHEMA).collect())] == [1, 2]
    (tmp_path / "a.json").write_text("[\n7\n")
    with pytest.raises(json_lines.NoJsonError):
        json_lines.read_tolerant(spark, str(tmp_path), SCHEMA)


def test_no_group_holds_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_objects(200, 10), indent=1))
    lines = spark.read.text(str(tmp_path)).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS split", "monotonically_increasing_id() AS n", "value")
    found = json_lines._elements(lines)
    assert found.count() == 200 and found.agg({"value": "max"}) is not None
    assert max(len(r.value) for r in found.collect()) < 400
    plan = json_lines.read_tolerant(spark, str(tmp_path), SCHEMA)._jdf.queryExecution().executedPlan().toString()
    collects = [line for line in plan.splitlines() if "collect_list" in line and "Aggregate(" in line]
    keys = [line.split("keys=[")[1].split("]")[0].split(", ") for line in collects]
    assert keys and all(len(k) == 2 for k in keys)  # file and number of the object
    assert "Python" not in plan


def test_only_pieces_of_objects_are_shuffled(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_objects(200, 11), indent=1))
    lines = spark.read.text(str(tmp_path)).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS split", "monotonically_increasing_id() AS n", "value")
    plan = json_lines._elements(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
