"""The comment and corpus tables as views over the generated test tables.

There is one comment per event; its text is that of the document ``event_id`` modulo
the number of documents.  Texts and figures stay apart (``texts`` and ``comments``), so
that no join has to shuffle texts unless an output needs them next to the figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions import text as txt

# The test texts are English, French, German and Spanish.
NEGATIONS = ("no", "nicht", "pas")
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "be", "as",
    "by", "de", "la", "en", "que", "le", "des", "der", "die", "und",
)
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
              "props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}
ALIASES = {"NATION_1": "N1", "NATION_2": "N2", "NATION_3": "N3"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``; a table of less than half as many splits as cores is spread first.

    Only the small test tables are that few files; nothing but bare scans goes through here.
    """
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores, "doc_id") if 2 * files <= cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``comment_id, content`` of all documents."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("comment_id"), F.col("text").alias("content"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per event, without texts; ``doc_id`` names the document with its text."""
    events = table(spark, sf_dir, "events")
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at every scale
    n = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()  # ids are 0 to n - 1
    reply = F.col("event_id") % 3 == 0
    return events.join(nation, F.col("n_nationkey") == F.col("user_id") % 25).select(
        F.col("event_id").alias("comment_id"), "user_id", F.col("ts").alias("created_at"),
        F.when(reply, 2).otherwise(1).alias("level"),
        F.floor(F.col("value") * F.col("value") / 10).cast("bigint").alias("likes"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("comments"),
        F.when(reply, 0).otherwise(F.floor("value")).cast("bigint").alias("shares"),
        F.col("n_name").alias("ip_location"),
        F.when(F.col("user_id") % 3 == 0, "f").when(F.col("user_id") % 3 == 1, "m").alias("gender"),
        F.pmod(F.col("event_id"), n).alias("doc_id"),
    )


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments without text or document."""
    return comments(spark, sf_dir).drop("doc_id")


def with_texts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` of ``comments`` with their texts as ``content`` instead of ``doc_id``."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return rows.join(bodies, "doc_id").drop("doc_id")


def full_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments with their texts."""
    return with_texts(spark, sf_dir, comments(spark, sf_dir))


def raw_levels(spark: SparkSession, sf_dir: str, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """The two raw tables, top-level comments and replies; without ``texts`` content only tells NULL."""
    if texts:
        rows = full_comments(spark, sf_dir)
    else:
        known = table(spark, sf_dir, "documents").select(
            "doc_id", F.when(F.col("text").isNotNull(), F.lit("")).alias("content"))
        rows = comments(spark, sf_dir).join(known, "doc_id").drop("doc_id")
    rows = rows.withColumnRenamed("created_at", "create_date_time")
    top_level = rows.filter("level = 1").select(
        "comment_id", "user_id", "create_date_time", "content",
        F.col("comments").alias("comments_count"), F.col("likes").alias("liked_count"),
        F.col("shares").alias("shared_count"), "ip_location", "gender",
    )
    replies = rows.filter("level = 2").select(
        "comment_id", "user_id", "create_date_time", "content",
        F.col("comments").alias("sub_comment_count"), F.col("likes").alias("comment_like_count"),
        "ip_location", "gender",
    )
    return top_level, replies


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, review, label`` of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        "doc_id", F.col("text").alias("review"), "label"
    )


# Every letter becomes a Han character; among them are negations and stop words.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN = "手机不没的用好会大小多少电池屏幕声音价格服务快慢新旧"


def in_han(text: F.Column) -> F.Column:
    return F.translate(F.lower(text), LATIN, HAN)


def han_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("content", in_han(F.col("content")))


def han_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("review", in_han(F.col("review")))


BUCKETS = 2000


def hashed_words(text: F.Column) -> F.Column:
    """Words as the numbers of ``BUCKETS`` buckets by MD5, which SQL engines share."""
    return F.transform(txt.words(text), lambda w: F.concat(
        F.lit("b"), (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("string")))
