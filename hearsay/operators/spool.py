"""Tables written to the cluster's shared folder so that later steps start from files.

Used where a result is needed more than once or has to be measured.  Files
survive the loss of executors, and reading them back prunes columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session, else one below its warehouse."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/hearsay/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written meanwhile; their readers must be done."""
    _open.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _open.pop():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spool(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return it read back; ``zstd`` suits texts."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def portions(stored: DataFrame, size: Column, least: int, most: int = 32) -> Iterator[DataFrame]:
    """All rows of a table that is read from files, some files at a time; one portion at least.

    A portion has ``least`` by the sum of ``size`` or one of ``most`` equal shares, whichever is more, and up to a file beyond.
    """
    file = F.col("_metadata.file_name")
    sizes = stored.groupBy(file.alias("file")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("size")).orderBy("file").collect()  # one row a file
    share = max(least, sum(row["size"] for row in sizes) / most)
    names, taken = [], 0
    for row in sizes:
        names, taken = [*names, row["file"]], taken + row["size"]
        if taken >= share:
            yield stored.filter(file.isin(names))
            names, taken = [], 0
    if names or not sizes:
        yield stored.filter(file.isin(names)) if names else stored
