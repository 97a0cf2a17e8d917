"""CSV records over several lines, read by many tasks.

A file is read as lines, by splits.  Whether a line begins inside a quoted value depends on all
lines before it, but a line only has two possible beginnings, so it is a function of that one bit: it
keeps it, turns it over, or ends inside or outside whatever came before.  A task composes these functions along
its splits, for both beginnings, into one row each; splits are composed by a running sum of turns since
the last one that ends inside or outside in any case, and records are numbered from the splits' numbers of
beginnings.  With its true beginning known, a task then puts the records of a split together where they are:
no text is shuffled but that of a record that goes over the end of a split.

Lines end with a line feed, or with a carriage return and one.  Quotes follow the reader of Spark: one opens a value at its beginning only, a doubled one within is a
character, and after a closing quote anything up to the delimiter is taken as it is.  A value whose quote is
never closed goes up to the end of its file, without the last line's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.spool import spool

#: A record over more splits than this ends in an error: a quote was hardly meant to span them.
MOST_SPLITS = 8
_PLAIN, _INSIDE, _CLOSED, _BEGIN = 0, 1, 2, 3
#: What a line does to the bit.
_KEEPS, _TURNS, _ENDS_OUTSIDE, _ENDS_INSIDE = 0, 1, 2, 3


def _ends_inside(parts: Column, begin: int, comma: str) -> Column:
    """Whether a line, given between its quotes, ends inside a quoted value."""

    def quote(state: Column, part: Column) -> Column:
        opens = part.endswith(comma) | ((part == "") & state.isin(_CLOSED, _BEGIN))
        return F.when(state == _INSIDE, _CLOSED).when(opens, _INSIDE).otherwise(_PLAIN)

    between = F.slice(parts, 1, F.size(parts) - 1)
    return F.aggregate(between, F.lit(begin), quote) == _INSIDE


def _lines(spark: SparkSession, path: str, comma: str) -> DataFrame:
    """``file, split, n, value, kind``: all lines; ``n`` rises within a split."""
    # A carriage return within a value stays there, one before the end of a record does not.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), "value")
    parts = F.split("value", '"', -1)
    quoted = F.contains(F.col("value"), F.lit('"'))
    # One number for both beginnings, so that each is followed once: 2 for inside of one that is outside, 1 of one that is inside.
    ends = F.when(quoted, 2 * _ends_inside(parts, _BEGIN, comma).cast("int") + _ends_inside(parts, _INSIDE, comma).cast("int")).otherwise(1)
    kinds = F.array(*map(F.lit, (_ENDS_OUTSIDE, _KEEPS, _TURNS, _ENDS_INSIDE)))
    return lines.withColumn("kind", F.get(kinds, ends))


def states(kinds: np.ndarray, begin: bool) -> np.ndarray:
    """The bit before every line, and after the last one."""
    turns = np.concatenate(([0], np.cumsum(kinds == _TURNS)))
    place = np.arange(1, len(kinds) + 1)
    last = np.concatenate(([0], np.maximum.accumulate(np.where(kinds >= _ENDS_OUTSIDE, place, 0))))
    known = np.concatenate(([begin], kinds == _ENDS_INSIDE))[last]
    return known ^ ((turns - turns[last]) % 2 == 1)


def split_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that belong to one split each: ``(file, split)`` and the rows."""
    if not len(batch):
        return
    codes = batch.column(0).dictionary_encode().indices.to_numpy()
    splits = batch.column(1).to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
        yield (batch.column(0)[a].as_py(), int(splits[a])), batch.slice(a, b - a)


_SUMMARY = ("file string, split bigint, starts_out bigint, starts_in bigint, `out` boolean, `in` boolean, "
            "first_out bigint, first_in bigint, last_out bigint, last_in bigint")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every split, as it is if it begins outside and inside: the number of beginnings of records, the bit at
    its end, ``n`` of the first beginning and of the last."""
    kinds_of = [pa.string(), *[pa.int64()] * 3, *[pa.bool_()] * 2, *[pa.int64()] * 4]
    names = [field.split()[0].strip("`") for field in _SUMMARY.split(", ")]

    def row(of: tuple, sides: list[dict]) -> pa.RecordBatch:
        values = [*of, *(side[k] for k in ("starts", "bit", "first", "last") for side in sides)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds_of)], names=names)

    of, sides = None, []
    for batch in batches:
        for found, part in split_runs(batch):
            if found != of:
                if of is not None:
                    yield row(of, sides)
                of, sides = found, [{"starts": 0, "bit": bit, "first": None, "last": None} for bit in (False, True)]
            n, kinds = part.column(2).to_numpy(), part.column(3).to_numpy()
            for side in sides:
                bits = states(kinds, side["bit"])
                begins = np.flatnonzero(~bits[:-1])
                side["bit"] = bool(bits[-1])
                if len(begins):
                    side["starts"] += len(begins)
                    side["first"] = int(n[begins[0]]) if side["first"] is None else side["first"]
                    side["last"] = int(n[begins[-1]])
    if of is not None:
        yield row(of, sides)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, record, value``: the records that begin and end in one split."""
    of, bit, record, held = None, False, 0, None  # the bit before a line, the last record begun, its lines if it is open

    def made(first: int, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(of[0], len(values)), pa.array(np.arange(first, first + len(values))), values],
                                          names=["file", "record", "value"])

    for batch in batches:
        for found, part in split_runs(batch):
            if found != of:
                of, bit, record, held = found, part.column(4)[0].as_py(), part.column(5)[0].as_py(), None
            values, bits = part.column(2), states(part.column(3).to_numpy(), bit)
            begins, bit = np.flatnonzero(~bits[:-1]), bool(bits[-1])
            if held is not None:  # without it the lines before the first beginning belong to another split
                held.extend(values.slice(0, int(begins[0]) if len(begins) else len(values)).to_pylist())
                if len(begins) or not bit:
                    yield made(record, pa.array(["\n".join(held)], pa.string()))
                    held = None
            limits = begins if bit else np.append(begins, len(values))
            if len(begins) and len(limits) > 1:
                if limits[-1] - limits[0] == len(limits) - 1:
                    lined = values.slice(int(limits[0]), len(limits) - 1)
                else:
                    lined = pc.binary_join(pa.ListArray.from_arrays(pa.array(limits, pa.int32()), values), "\n")
                yield made(record + 1, lined)
            record += len(begins)
            if len(begins) and bit:
                held = values.slice(int(begins[-1])).to_pylist()


def _odd(number: Column) -> Column:
    return number % 2 == 1


def _composed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """With ``known``, the bit before a row if a row before it fixes it, and ``turned``, whether it was turned over since."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("turns", F.sum("turn").over(upto))
    mark = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    last = summed.withColumn("mark", F.last(mark, ignorenulls=True).over(before)).withColumn(
        "earlier", F.col("turns") - F.col("turn"))
    return last.withColumn("known", F.col("mark.fixed")).withColumn(
        "turned", _odd(F.col("earlier") - F.coalesce("mark.turns", F.lit(0)))).drop("mark", "earlier")


def _bit(begin: Column) -> Column:
    """The bit before a row, if its split begins with ``begin``."""
    return F.coalesce("known", begin) != F.col("turned")


def _splits(lines: DataFrame) -> DataFrame:
    """``file, split, begin, offset, starts, first, last, open``: one row for every split, with its true beginning.

    ``offset`` is the number of records begun before it, ``open`` whether it ends inside a record.
    """
    splits = lines.select("file", "split", "n", "kind").mapInArrow(_summaries, _SUMMARY)
    splits = splits.withColumn("fixed", F.when(F.col("out") == F.col("in"), F.col("out"))).withColumn(
        "turn", (F.col("out") & ~F.col("in")).cast("long"))
    splits = _composed(splits, ["file"], "split").withColumn("begin", _bit(F.lit(False)))
    true = lambda outside, inside: F.when(F.col("begin"), F.col(inside)).otherwise(F.col(outside))
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("starts", true("starts_out", "starts_in")).withColumn("place", F.row_number().over(upto))
    started = F.max(F.when(F.col("starts") > 0, F.col("place"))).over(upto)
    too_long = F.raise_error(F.concat(F.lit("a quoted value is not closed in "), F.col("file"))).cast("long")
    offset = F.sum("starts").over(upto) - F.col("starts")
    offset = F.when(F.col("place") - started > MOST_SPLITS, too_long).otherwise(offset)
    return splits.select("file", "split", "begin", offset.alias("offset"), "starts", true("first_out", "first_in").alias("first"),
                         true("last_out", "last_in").alias("last"), true("out", "in").alias("open"))


def records(spark: SparkSession, path: str, comma: str = ",") -> DataFrame:
    """``file, record, value``: the records of all files below ``path``, numbered from 1 within a file.

    The files are read once to find the splits' beginnings, which are written below the shared folder.
    """
    lines = _lines(spark, path, comma)
    splits = F.broadcast(spool(_splits(lines), "splits"))
    placed = lines.join(splits.select("file", "split", "begin", "offset"), ["file", "split"])
    whole = placed.select("file", "split", "value", "kind", "begin", "offset").mapInArrow(
        _whole, "file string, record bigint, value string")
    # What a split has of records that go over its limits.
    ends_open = F.col("open") & (F.col("n") >= F.col("last"))
    pieces = lines.select("file", "split", "n", "value").join(splits, ["file", "split"]).filter(
        F.col("first").isNull() | (F.col("n") < F.col("first")) | ends_open)
    record = F.when(F.coalesce(ends_open, F.lit(False)), F.col("offset") + F.col("starts")).otherwise(F.col("offset"))
    several = pieces.groupBy("file", record.alias("record")).agg(
        F.sort_array(F.collect_list(F.struct("split", "n", "value"))).alias("lines"))
    found = whole.unionByName(several.select("file", "record", F.array_join("lines.value", "\n").alias("value")))
    return found.withColumn("value", F.when(F.col("value").endswith("\r"), F.expr("left(value, char_length(value) - 1)"))
                            .otherwise(F.col("value")))


def read_spread(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The rows of CSV files with one and the same header, all of a file's splits read by tasks of their own."""
    head = spark.read.text(path).first()
    found = records(spark, path, options.get("sep", ","))
    first = F.col("record") == 1
    same = F.when(first & (F.col("value") != head["value"]), F.raise_error(
        F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")).otherwise(~first)
    rows = found.filter(same & (F.col("value") != ""))
    parsing = {k: v for k, v in options.items() if k != "header"}
    return rows.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                                  parsing).alias("row")).select("row.*")


def has_large_file(spark: SparkSession, path: str) -> bool:
    """Whether a file below ``path`` that has splits is larger than what one task reads; most compressed files have none."""
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike(r"\.(gz|deflate|lz4|snappy|zst)$"))
    largest = files.select("length").agg(F.max("length")).first()[0]
    return (largest or 0) > split
