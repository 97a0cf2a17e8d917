"""Comment tables: raw CSV, stored Parquet, labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.clean import to_analysis
from hearsay.schemas import CORPUS_SCHEMA, REPLY_SCHEMA, TOP_LEVEL_SCHEMA
from hearsay.sources import records

# Quotes inside quoted values are doubled, the usual CSV dialect.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


class UnclosedQuoteError(ValueError):
    """A quoted value runs over the end of its line, in a mode that reads by line."""


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; every file of a folder needs the same header, another one is an error.

    Columns the files lack are left out, columns outside ``schema`` are read as text.
    ``multi_line`` accepts line breaks inside quoted values.  Files that one task would take long to
    read are then read by many, see ``sources.records``.  Without it files are read line by line, and a
    line with an unclosed quote is an error.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower())
    if not multi_line:
        # An odd number of quotes: the value goes on in the next line.
        quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).filter(quotes % 2 == 1).isEmpty():
            raise UnclosedQuoteError(f"a quoted value in {path} has a line break: read it with multi_line")
    # Reading only a header: no inference pass over the data.
    names = reader.csv(path).columns
    known = {field.name: field for field in schema}
    found = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    if multi_line and records.has_large_file(spark, path):
        return records.read_spread(spark, path, found, CSV_OPTIONS)
    # Spark matches by position; without enforcement it compares the header of every file.
    return reader.schema(found).option("enforceSchema", "false").csv(path)


def read_top_level_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, TOP_LEVEL_SCHEMA, multi_line)


def read_replies_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, REPLY_SCHEMA, multi_line)


def read_corpus_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, CORPUS_SCHEMA, multi_line).select("review", "label")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """CSV with a header and no index; empty text reads back as NULL, as always in CSV.

    With a ``compression`` (``gzip``) files take a fraction of the space, but each is read by one task.
    """
    (
        df.write.mode(mode).options(**CSV_OPTIONS).option("compression", compression)
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def write_stored(
    df: DataFrame, path: str, fmt: str = "parquet", sub_dir: str | None = None, files: int | None = None
) -> str:
    """Replace the stored table; the number of files is only forced if given."""
    target = f"{path.rstrip('/')}/{sub_dir}" if sub_dir else path
    if files is not None:
        df = df.repartition(files)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")  # most of it is text
    writer.save(target)
    return target


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored Parquet table (a directory or one part file) as analysis columns.

    ``row_id`` is made of file and row position: it tells equal comments apart and
    stays the same on every read.  It also serves as ``comment_id`` if there is none.
    """
    row_id = F.concat_ws("#", F.md5("_metadata.file_path"), F.col("_metadata.row_index"))
    df = spark.read.parquet(path).select(row_id.alias("row_id"), "*")
    if "comment_id" not in df.columns:
        df = df.withColumn("comment_id", F.col("row_id"))
    return to_analysis(df)
