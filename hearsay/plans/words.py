"""Words: tokens per comment, frequent words and their polarity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as txt
from hearsay.vocabulary import STOP_WORDS


def token_counts(
    texts: DataFrame, stop_words: Iterable[str] = STOP_WORDS, tokenizer: txt.Tokenizer = txt.words
) -> DataFrame:
    """``comment_id, n_words, n_tokens``: before and after dropping stop words."""
    listed = texts.select("comment_id", tokenizer(F.col("content")).alias("words"))
    return listed.select(
        "comment_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(txt.drop_stop_words(F.col("words"), stop_words)).cast("bigint").alias("n_tokens"),
    )


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """``word, count``: lines split at every single space."""
    by_line = F.split(F.col(text), r"[ \n]")
    return lines.select(F.explode(by_line).alias("word")).groupBy("word").count()


def occurrences(
    texts: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    tokenizer: txt.Tokenizer = txt.words,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``carry..., word``: one row per word of a text that is not a stop word."""
    tokens = txt.explode_words(texts, "content", tokenizer, *carry)
    return tokens.filter((F.col("word") != "") & ~F.col("word").isin(list(stop_words)))


def _named(polarity: Column) -> Column:
    return F.when(polarity > 0, "positive").when(polarity < 0, "negative").otherwise("neutral")


def most_frequent(counts: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` words with the highest ``count``, in alphabetical order among equals."""
    return counts.orderBy(F.desc("count"), "word").limit(n)


def with_polarity(counts: DataFrame, lexicon: DataFrame, n: int = 50) -> DataFrame:
    """``word, count, sentiment`` of the ``n`` most frequent words.

    ``counts(word, count)`` may hold a word many times.  Counts and lexicon meet in
    one aggregation by word, combined on the map side, instead of a join that hot
    words would skew.
    """
    unknown = F.lit(None).cast("int").alias("polarity")
    listed = lexicon.select("word", F.lit(0).cast("bigint").alias("count"), "polarity")
    merged = (
        counts.select("word", F.col("count").cast("bigint").alias("count"), unknown)
        .unionByName(listed).groupBy("word")
        .agg(F.sum("count").alias("count"), F.max("polarity").alias("polarity"))
    )
    top = most_frequent(merged.filter(F.col("count") > 0), n)
    return top.select("word", "count", _named(F.col("polarity")).alias("sentiment"))


def frequent_words(
    texts: DataFrame,
    lexicon: DataFrame,
    n: int = 50,
    stop_words: Iterable[str] = STOP_WORDS,
    tokenizer: txt.Tokenizer = txt.words,
) -> DataFrame:
    """``word, count, sentiment`` of the ``n`` most frequent words of ``texts``."""
    tokens = occurrences(texts, stop_words, tokenizer)
    return with_polarity(tokens.select("word", F.lit(1).alias("count")), lexicon, n)


def top_words(
    texts: DataFrame,
    n: int = 50,
    stop_words: Iterable[str] = STOP_WORDS,
    tokenizer: txt.Tokenizer = txt.words,
) -> DataFrame:
    """``word, count`` of the ``n`` most frequent words of ``texts``."""
    return most_frequent(occurrences(texts, stop_words, tokenizer).groupBy("word").count(), n)
