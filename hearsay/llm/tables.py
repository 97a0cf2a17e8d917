"""Reading the document tables, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is there.

    On a cluster the package is shipped (``--py-files``) or installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Rows are whole texts: the usual 10,000 of them in a batch would take much of a worker's memory.
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given columns of ``documents``; only those are scanned."""
    importable(spark)
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").select(*columns)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset (tests), a folder below the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps start from its files.

    It cuts the lineage, survives the loss of executors, and every reader of it sees
    the same rows even where the rows' origin is not repeatable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: str, divisor: int) -> F.Column:
    """``crc32(key as text) mod divisor``, the contract's folds."""
    return F.crc32(F.col(key).cast("string")) % divisor


def md5_unit(*columns) -> F.Column:
    """A number in [0, 1) from the MD5 of the columns' texts; SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("double") / 4294967296.0


def as_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
