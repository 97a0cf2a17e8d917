"""Lexicon from a labelled corpus, and lexicon sentiment with negation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as txt
from hearsay.operators.lookup import DEFAULT_BOUND, Bound, score_tokens
from hearsay.vocabulary import NEGATIONS


def class_word_counts(corpus: DataFrame, tokenizer: txt.Tokenizer = txt.words) -> DataFrame:
    """``word, positive, negative``: occurrences per class of ``corpus(review, label)``."""
    tokens = txt.explode_words(corpus, "review", tokenizer, "label").filter(F.col("word").isNotNull())
    return tokens.groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )


def build_lexicon(
    corpus: DataFrame,
    min_freq: int = 1,
    keep_common: bool = False,
    tokenizer: txt.Tokenizer = txt.words,
) -> DataFrame:
    """``word, polarity, freq``: +1 / -1 for words seen in one class only.

    ``keep_common`` adds the words of both classes with polarity 0; they score
    nothing, but scoring a large vocabulary is cheaper when they are known.
    """
    counts = class_word_counts(corpus, tokenizer)
    positive, negative = F.col("positive") >= min_freq, F.col("negative") >= min_freq
    polarity = positive.cast("int") - negative.cast("int")
    lexicon = counts.select(
        "word", polarity.alias("polarity"), (F.col("positive") + F.col("negative")).alias("freq")
    )
    return lexicon if keep_common else lexicon.filter(F.col("polarity") != 0)


def signed_tokens(
    comments: DataFrame,
    ids: Sequence[str],
    negations: Iterable[str] = NEGATIONS,
    tokenizer: txt.Tokenizer = txt.words,
) -> DataFrame:
    """``ids..., word, sign``: -1 right after a negation, 0 for the negation itself."""
    listed = list(negations)
    entries = comments.select(*ids, tokenizer(F.col("content")).alias("words")).select(
        *ids, F.inline(txt.with_previous(F.col("words")))
    )
    sign = (
        F.when(F.col("word").isin(listed), 0).when(F.col("previous").isin(listed), -1).otherwise(1)
    )
    return entries.select(*ids, "word", sign.alias("sign"))


def label_sentiment(
    comments: DataFrame,
    lexicon: DataFrame,
    negations: Iterable[str] = NEGATIONS,
    carry: Sequence[str] = (),
    tokenizer: txt.Tokenizer = txt.words,
    bound: Bound = DEFAULT_BOUND,
    key: str = "comment_id",
) -> DataFrame:
    """``key, carry..., sentiment`` of ``comments(key, content, carry...)``.

    Each word adds its polarity, reversed if the word before it is a negation;
    the sign of the sum decides, no sum (or NULL text) is neutral.  ``key`` must
    tell rows apart: rows that agree in it and in ``carry`` become one.

    The text itself is never shuffled, only one partial sum per comment is.
    ``lexicon(word, polarity[, freq])`` is read twice, first to measure it: pass a
    table that starts from files.
    """
    freq = F.col("freq") if "freq" in lexicon.columns else F.lit(1)
    weights = lexicon.select("word", F.col("polarity").alias("weight"), freq.alias("freq"))
    ids = [key, *carry]
    scored = score_tokens(signed_tokens(comments, ids, negations, tokenizer), weights, ids, bound)
    sentiment = (
        F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral")
    )
    return scored.select(*ids, sentiment.alias("sentiment"))
