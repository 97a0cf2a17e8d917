"""Cleaning: drop identifiers and incomplete rows, merge the two comment levels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.schemas import (
    ANALYSIS_NAMES, COUNT_COLUMNS, IDENTIFIERS, KEPT_IDS, RAW_COLUMNS, REPLY_NAMES, STORED_NAMES,
    TIMESTAMP_PATTERN, TOP_LEVEL_IDENTIFIERS,
)


def drop_columns(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop the listed columns; names the table does not have are ignored."""
    kept = set(keep)
    return df.drop(*[c for c in columns if c not in kept])


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the table does not have are skipped."""
    return df.withColumnsRenamed(dict(names))


def align(df: DataFrame, columns: Sequence[str], like: DataFrame) -> DataFrame:
    """Exactly ``columns`` in this order; missing ones are NULL typed as in ``like``."""
    types = dict(zip(like.columns, (field.dataType for field in like.schema), strict=True))
    return df.select([
        F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns
    ])


def _kept_ids(df: DataFrame) -> list[str]:
    return [c for c in KEPT_IDS if c in df.columns]


def _complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def prepare_top_level(raw: DataFrame, keep_ids: bool = True) -> tuple[DataFrame, list[str]]:
    """Top-level table without identifiers, and the columns that must not be NULL."""
    ids = _kept_ids(raw) if keep_ids else []
    df = drop_columns(raw, TOP_LEVEL_IDENTIFIERS, keep=ids)
    return df, [c for c in df.columns if c not in ids]


def prepare_replies(raw: DataFrame, keep_ids: bool = True) -> tuple[DataFrame, list[str]]:
    """Reply table without identifiers, and the columns that must not be NULL."""
    ids = _kept_ids(raw) if keep_ids else []
    df = drop_columns(raw, IDENTIFIERS, keep=ids)
    return df, [c for c in df.columns if c not in ids]


def _aligned(top_level: DataFrame, replies: DataFrame, keep_ids: bool):
    """Both levels in one layout, each row with its completeness before the merge."""
    first, first_required = prepare_top_level(top_level, keep_ids)
    second, second_required = prepare_replies(replies, keep_ids)
    first = first.withColumn("_complete", _complete(first_required))
    second = second.withColumn("_complete", _complete(second_required))
    count_type = first.schema["shared_count"].dataType
    second = rename(second, REPLY_NAMES).withColumn("shared_count", F.lit(0).cast(count_type))
    return first, align(second, first.columns, like=first), first_required


def clean_merge(top_level: DataFrame, replies: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One table of complete comments in the raw layout of the top level.

    Rows with a NULL in any column of their own level are dropped, replies get
    ``shared_count = 0`` and the top level's layout (absent columns become NULL),
    both are united with duplicates kept, and rows with a NULL are dropped again.
    """
    first, second, required = _aligned(top_level, replies, keep_ids)
    merged = first.unionByName(second)
    return merged.filter(F.col("_complete") & _complete(required)).drop("_complete")


def null_drop_audit(top_level: DataFrame, replies: DataFrame) -> DataFrame:
    """``stage, rows_in, rows_out, rows_dropped`` of the three drops, in one pass."""
    first, second, required = _aligned(top_level, replies, keep_ids=False)
    flags = [F.col("_complete"), (F.col("_complete") & _complete(required)).alias("_kept")]
    rows = first.select(F.lit(1).alias("level"), *flags).unionByName(
        second.select(F.lit(2).alias("level"), *flags)
    )
    is_top, whole = F.col("level") == 1, F.col("_complete")
    totals = rows.agg(
        F.count_if(is_top).alias("in1"), F.count_if(is_top & whole).alias("out1"),
        F.count_if(~is_top).alias("in2"), F.count_if(~is_top & whole).alias("out2"),
        F.count_if("_kept").alias("kept"),
    )
    stages = [
        ("level1", F.col("in1"), F.col("out1")),
        ("level2", F.col("in2"), F.col("out2")),
        ("merged", F.col("out1") + F.col("out2"), F.col("kept")),
    ]
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(stage).alias("stage"), rows_in.alias("rows_in"), rows_out.alias("rows_out"),
                 (rows_in - rows_out).alias("rows_dropped"))
        for stage, rows_in, rows_out in stages
    ])))


def to_stored(df: DataFrame) -> DataFrame:
    """Raw names -> names of the stored table."""
    return rename(df, STORED_NAMES)


def to_analysis(df: DataFrame) -> DataFrame:
    """Stored names -> typed analysis columns.

    Counts that are not plain integers and timestamps that do not parse become NULL.
    """
    df = rename(df, ANALYSIS_NAMES)
    created = F.col("created_at")
    if dict(df.dtypes)["created_at"] == "string":
        created = F.coalesce(
            F.try_to_timestamp(created, F.lit(TIMESTAMP_PATTERN)), created.try_cast("timestamp")
        )
    return df.withColumns({
        "created_at": created, **{c: F.col(c).try_cast("bigint") for c in COUNT_COLUMNS},
    })


def profile(df: DataFrame) -> DataFrame:
    """``column, rows, non_null`` of every column, in one pass."""
    totals = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n_{i}").alias("non_null"))
        for i, c in enumerate(df.columns)
    ])))


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in a defined order."""
    return df.orderBy(order_by).limit(n)


def raw_columns(df: DataFrame) -> DataFrame:
    """Only the columns that are stored, in stored order, after any kept ids."""
    return df.select(*_kept_ids(df), *[c for c in RAW_COLUMNS if c in df.columns])
