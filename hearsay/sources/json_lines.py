"""JSON in and out: one object per line, or documents over many lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.spool import spool
from hearsay.sources.records import split_runs


_BLANKS = " \t\r\n"


class NoJsonError(ValueError):
    """Nothing below the path could be read as JSON."""


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, as many files as the data has partitions; replaces old output."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per line that holds a JSON object; other lines are skipped.

    A field of another type than declared becomes NULL, the row stays.
    """
    value = F.col("value")
    valid = F.try_parse_json(value).isNotNull() & F.ltrim(value).startswith("{")
    lines = spark.read.text(path).filter(valid)
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("row")).select("row.*")


def _objects(value: Column, schema: T.StructType) -> Column:
    """The objects of a JSON value: itself, or the elements of an array."""
    several = F.from_json(value, T.ArrayType(schema), {"mode": "PERMISSIVE"})
    is_object = F.ltrim(value, F.lit(_BLANKS)).startswith("{")
    one = F.array(F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    return F.filter(F.when(is_object, one).otherwise(several), lambda row: row.isNotNull())


#: A string, which does not go over the end of a line; a backslash with what it escapes; a bracket.
_TOKEN = re.compile(r'"(?:[^"\\]+|\\["\\]?)*"?|\\["\\]?|[{}\[\]]')


def _brackets(line: str) -> list[tuple[int, int]]:
    """The places of a line's brackets outside of strings, and +1 or -1."""
    if not any(c in line for c in "{}[]"):
        return []
    return [(m.start(), 1 if m[0] in "{[" else -1) for m in _TOKEN.finditer(line) if m[0] in "{}[]"]


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, split, change, low, first`` of every split: by how much it ends deeper, its least depth, its first bracket."""
    of, change, low, first = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            (*of, change, low, first), (pa.string(), *[pa.int64()] * 3, pa.string()))], names=["file", "split", "change", "low", "first"])

    for batch in batches:
        for found, part in split_runs(batch):
            if found != of:
                if of is not None:
                    yield row()
                of, change, low, first = found, 0, 0, None
            for line in part.column(2).to_pylist():
                for at, step in _brackets(line):
                    change += step
                    low = min(low, change)
                    if first is None and step > 0:
                        first = line[at]
    if of is not None:
        yield row()


def _parts(pieces: bool):
    """``file, start, split, value``: the objects that begin and end in a split, or the ``pieces`` of the others.

    A piece's ``start`` is the split where its object begins.
    """

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          names=["file", "start", "split", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, depth, base, start, text, came = None, 0, 0, 0, None, False  # the text of the object that is open, and whether it came so
        for batch in batches:
            rows = []
            for found, part in split_runs(batch):
                if found != of:
                    if pieces and text is not None:
                        rows.append((of[0], start, of[1], "".join(text)))
                    of, depth, base = found, part.column(3)[0].as_py(), part.column(4)[0].as_py()
                    start, came = part.column(5)[0].as_py(), depth > base
                    text = [] if came else None
                for line in part.column(2).to_pylist():
                    begin = 0
                    if text is not None:
                        text.append("\n")
                    for at, step in _brackets(line):
                        if step > 0 and depth == base:
                            start, text, begin, came = of[1], [], at, False
                        depth += step
                        if step < 0 and depth == base and text is not None:
                            text.append(line[begin:at + 1])
                            if pieces == came:
                                rows.append((of[0], start, of[1], "".join(text)))
                            text = None
                    if text is not None:
                        text.append(line[begin:])
            if rows:
                yield made(rows)
        if pieces and text is not None:
            yield made([(of[0], start, of[1], "".join(text))])

    return run


def _elements(lines: DataFrame) -> DataFrame:
    """``file, value``: the objects of documents over many lines, from ``lines(file, split, n, value)``.

    Strings do not go over the end of a line, so brackets are found line by line.  Their depth is summed
    within a split and then over splits.  Objects begin at depth 0, or 1 if the file's first bracket is
    square.  They are put together in their split; only the pieces of those over several splits are shuffled.
    """
    splits = lines.select("file", "split", "value").mapInArrow(_depths, "file string, split bigint, change bigint, low bigint, first string")
    by_file = Window.partitionBy("file").orderBy("split")
    ahead, every = by_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    first = F.min(F.when(F.col("first").isNotNull(), F.struct("split", "first"))).over(every)
    splits = splits.withColumn("base", F.when(first["first"] == "[", 1).otherwise(0).cast("bigint")).withColumn(
        "above", F.coalesce(F.sum("change").over(ahead), F.lit(0)))
    # The object that is open at the end of a split began there, unless it was open all the time.
    began = (F.col("above") + F.col("change") > F.col("base")) & (
        (F.col("above") <= F.col("base")) | (F.col("above") + F.col("low") <= F.col("base")))
    start = F.last(F.when(began, F.col("split")), ignorenulls=True).over(ahead)
    splits = splits.select("file", "split", "above", "base", F.coalesce(start, F.lit(-1)).alias("start"))
    placed = lines.join(F.broadcast(spool(splits, "splits")), ["file", "split"]).select("file", "split", "value", "above", "base", "start")
    kind = "file string, start bigint, split bigint, value string"
    several = placed.mapInArrow(_parts(pieces=True), kind).groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("split", "value"))).alias("parts"))
    whole = placed.mapInArrow(_parts(pieces=False), kind).select("file", "value").unionByName(
        several.select("file", F.array_join("parts.value", "").alias("value")))
    return whole.filter(F.ltrim("value", F.lit(_BLANKS)).startswith("{") & F.try_parse_json("value").isNotNull())


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All JSON objects below ``path``, whichever way each file holds them.

    A file of which at least half of the lines are an object or array by themselves is read line by
    line, and other lines are skipped.  Any other file holds objects, or arrays of objects, over many lines;
    objects that do not parse are skipped.  Both are read by many tasks, and only the lines of one object
    are ever put together.  Raises :class:`NoJsonError` if nothing is found.
    """
    value = F.col("value")
    begin = F.substring(F.ltrim(value, F.lit(_BLANKS)), 1, 1)
    lines = spark.read.text(path).filter(begin != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        # Lines of a split have rising numbers.
        F.monotonically_increasing_id().alias("n"),
        "value", (begin.isin("{", "[") & F.try_parse_json(value).isNotNull()).alias("complete"),
    )
    by_line = F.count_if("complete") * 2 >= F.count("*")
    kinds = lines.groupBy("file").agg(by_line.alias("by_line"))
    alone = lines.filter("complete").join(kinds.filter("by_line").select("file"), "file", "semi")
    spread = lines.join(kinds.filter("NOT by_line").select("file"), "file", "semi")
    values = alone.select("value").unionByName(_elements(spread.select("file", "split", "n", "value")).select("value"))
    rows = values.select(F.inline(_objects(value, schema)))
    if rows.isEmpty():
        raise NoJsonError(f"no JSON in {path}")
    return rows
