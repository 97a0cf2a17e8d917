"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes the rows its predecessor kept and returns rows with the columns of
``documents``; the last returns the pieces of the packed sequences.  Stages start from
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import mixing, near_dedup, packing, pii, toxicity
from hearsay.llm.tables import importable, labels, remainder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects."""
    importable(spark)
    known = labels(spark, sf_dir).filter(remainder("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.accepted(docs, toxicity.fit(docs.select("doc_id", "text"), known))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates."""
    importable(spark)
    return near_dedup.dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` is that of the new text."""
    importable(spark)
    model = pii.fit(docs.select("doc_id", "text"))
    others = [c for c in docs.columns if c != "text"]
    clean = pii.redact(docs, model, carry=tuple(others))
    if "n_chars" in others:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.char_length("text").cast(kind))
    return clean.select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    importable(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in a packed sequence."""
    importable(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, alignments and greedy packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
