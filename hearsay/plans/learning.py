"""Naive Bayes sentiment: on the exact vocabulary in closed form, and on hashed terms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as txt
from hearsay.operators.lookup import DEFAULT_BOUND, Bound, score_columns, score_tokens
from hearsay.operators.spool import spool
from hearsay.vocabulary import STOP_WORDS

HASH_BUCKETS = 2000
MIN_DOC_FREQ = 5
MOST_CLASSES = 64
SMOOTHING = 1.0
SEED = 42


class EmptyCorpusError(ValueError):
    """There is no labelled text to learn from."""


def default_tokens(text):
    """Words without stop words, the tokens the classifiers learn from."""
    return txt.drop_stop_words(txt.words(text), STOP_WORDS)


def _place(salt: str, seed: int, keys) -> Column:
    """A number in [0, 1) from the MD5 of the keys, which does not depend on partitions."""
    text = F.concat_ws("|", F.lit(f"{salt}{seed}"), *keys)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def numbered(corpus: DataFrame) -> DataFrame:
    """``corpus`` with the number of a row among its equals as ``copy``: all rows differ then."""
    equal = corpus.groupBy(*corpus.columns).agg(F.count("*").cast("int").alias("copies"))
    return equal.select(*corpus.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def hash_split(
    corpus: DataFrame, keys: Sequence[str] | None = None, fraction: float = 1.0, test_share: float = 0.2, seed: int = SEED
):
    """``(train, test)`` of a sample without replacement, by hashes of the key columns.

    Without ``keys`` all columns count, so equal rows go the same way.  The same rows
    give the same parts, however they are distributed.
    """
    if corpus.isEmpty():
        raise EmptyCorpusError("the labelled corpus is empty")
    keys = list(keys or corpus.columns)
    sampled = corpus if fraction >= 1.0 else corpus.filter(_place("sample", seed, keys) < fraction)
    held_out = _place("test", seed, keys) < test_share
    return sampled.filter(~held_out), sampled.filter(held_out)


def key_split(corpus: DataFrame, key: str, parts: int = 5):
    """``(train, test)``: one part in ``parts`` is held out by key, the same on every run."""
    held_out = F.pmod(F.col(key), F.lit(parts)) == 0
    return corpus.filter(~held_out), corpus.filter(held_out)


# --- exact vocabulary --------------------------------------------------------


@dataclass(frozen=True)
class BayesModel:
    """Two-class multinomial model: per word and overall, the log odds of class 1."""

    weights: DataFrame  # word, weight, freq
    intercept: float


def term_statistics(train: DataFrame, tokenizer: txt.Tokenizer = txt.words, classes: Sequence = (0, 1)) -> DataFrame:
    """``word, tf0, tf1, ..., df`` of ``train(review, label)``; the NULL word counts the texts.

    There is one ``tf`` for each of ``classes``.  Sorting the words inside a row marks first
    occurrences, so document frequencies need no shuffle of (text, word) pairs: one
    aggregation by word, combined on the map side, gives everything.
    """
    entries = train.select("label", F.sort_array(tokenizer(F.col("review"))).alias("words")).select(
        "label", F.inline(txt.with_previous(F.col("words")))
    )
    return entries.groupBy("word").agg(
        *[F.count_if(F.col("label") == c).alias(f"tf{i}") for i, c in enumerate(classes)],
        F.count_if(F.col("word") != F.col("previous")).alias("df"),
    )


def fit_bayes(
    train: DataFrame,
    min_df: int = MIN_DOC_FREQ,
    smoothing: float = SMOOTHING,
    tokenizer: txt.Tokenizer = txt.words,
    size: int | None = None,
) -> BayesModel:
    """Multinomial Naive Bayes on tf-idf of every word of the corpus.

    ``size`` is the number of possible words that smoothing counts, by default those seen.
    """
    stats = spool(term_statistics(train, tokenizer), "terms")
    is_word, used = F.col("word").isNotNull(), F.col("df") >= min_df
    log_df = F.log(F.col("df") + 1)

    def total(value):
        return F.coalesce(F.sum(F.when(is_word & used, value)), F.lit(0)).cast("double")

    t = stats.agg(  # eight numbers, whatever the vocabulary
        F.max(F.when(~is_word, F.col("tf0"))).alias("n0"),
        F.max(F.when(~is_word, F.col("tf1"))).alias("n1"),
        F.count("word").alias("size"),
        total(F.col("tf0")).alias("tf0"), total(F.col("tf1")).alias("tf1"),
        total(F.col("tf0") * log_df).alias("log0"), total(F.col("tf1") * log_df).alias("log1"),
    ).first()
    if not (t["n0"] or t["n1"]):
        raise EmptyCorpusError("the labelled corpus is empty")

    log_texts = math.log(t["n0"] + t["n1"] + 1)
    mass0 = log_texts * t["tf0"] - t["log0"] + smoothing * (size or t["size"])
    mass1 = log_texts * t["tf1"] - t["log1"] + smoothing * (size or t["size"])
    idf = F.lit(log_texts) - log_df
    odds = (
        F.log(F.col("tf1") * idf + smoothing) - F.log(F.col("tf0") * idf + smoothing)
        - F.lit(math.log(mass1) - math.log(mass0))
    )
    weights = stats.filter(is_word & used).select(
        "word", (idf * odds).alias("weight"), (F.col("tf0") + F.col("tf1")).alias("freq")
    )
    return BayesModel(weights, math.log(t["n1"] + smoothing) - math.log(t["n0"] + smoothing))


def predict_bayes(
    model: BayesModel,
    texts: DataFrame,
    tokenizer: txt.Tokenizer = txt.words,
    bound: Bound = DEFAULT_BOUND,
) -> DataFrame:
    """``doc_id, prediction`` of ``texts(doc_id, review)``; equal odds mean class 0."""
    tokens = txt.explode_words(texts, "review", tokenizer, "doc_id")
    scored = score_tokens(tokens.withColumn("sign", F.lit(1)), model.weights, ["doc_id"], bound)
    odds = F.round(F.col("score") + F.lit(model.intercept), 6)
    return scored.select("doc_id", (odds > 0).cast("int").alias("prediction"))


# --- any number of classes -----------------------------------------------------


@dataclass(frozen=True)
class ClassModel:
    """Multinomial model of several classes: per word and overall, the log probability in each."""

    weights: DataFrame  # word, w0, w1, ... by class, freq
    classes: list  # ascending
    priors: list[float]


def fit_classes(
    train: DataFrame,
    min_df: int = MIN_DOC_FREQ,
    smoothing: float = SMOOTHING,
    tokenizer: txt.Tokenizer = txt.words,
    most_classes: int = MOST_CLASSES,
) -> ClassModel:
    """``fit_bayes`` for the labels that ``train(review, label)`` has, of any type; rows without one do not count."""
    labelled = train.filter(F.col("label").isNotNull())
    classes = sorted(r[0] for r in labelled.select("label").distinct().limit(most_classes + 1).collect())
    if not classes:
        raise EmptyCorpusError("the labelled corpus is empty")
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    stats = spool(term_statistics(labelled, tokenizer, classes), "class_terms")
    is_word, used, places = F.col("word").isNotNull(), F.col("df") >= min_df, range(len(classes))
    log_df = F.log(F.col("df") + 1)

    def total(value):
        return F.coalesce(F.sum(F.when(is_word & used, value)), F.lit(0)).cast("double")

    t = stats.agg(  # three numbers a class, whatever the vocabulary
        F.count("word").alias("size"),
        *[F.max(F.when(~is_word, F.col(f"tf{i}"))).alias(f"n{i}") for i in places],
        *[total(F.col(f"tf{i}")).alias(f"tf{i}") for i in places],
        *[total(F.col(f"tf{i}") * log_df).alias(f"log{i}") for i in places],
    ).first()
    texts = sum(t[f"n{i}"] for i in places)
    log_texts = math.log(texts + 1)
    idf = F.lit(log_texts) - log_df

    def weight(i: int) -> Column:
        mass = log_texts * t[f"tf{i}"] - t[f"log{i}"] + smoothing * t["size"]
        return idf * (F.log(F.col(f"tf{i}") * idf + smoothing) - F.lit(math.log(mass)))

    freq = reduce(Column.__add__, [F.col(f"tf{i}") for i in places])
    weights = stats.filter(is_word & used).select("word", *[weight(i).alias(f"w{i}") for i in places], freq.alias("freq"))
    whole = math.log(texts + smoothing * len(classes))
    return ClassModel(weights, classes, [math.log(t[f"n{i}"] + smoothing) - whole for i in places])


def predict_classes(
    model: ClassModel,
    texts: DataFrame,
    tokenizer: txt.Tokenizer = txt.words,
    bound: Bound = DEFAULT_BOUND,
) -> DataFrame:
    """``doc_id, prediction`` of ``texts(doc_id, review)``: the likeliest class, of equal ones the least."""
    tokens = txt.explode_words(texts, "review", tokenizer, "doc_id")
    names = [f"w{i}" for i in range(len(model.classes))]
    sums = score_columns(tokens.withColumn("sign", F.lit(1)), model.weights, ["doc_id"], names, bound)
    ways = [F.struct(F.round(F.col(name) + F.lit(prior), 6).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("class"))
            for i, (name, prior, c) in enumerate(zip(names, model.priors, model.classes))]
    return sums.select("doc_id", F.array_max(F.array(*ways))["class"].alias("prediction"))


# --- hashed terms ------------------------------------------------------------


def fit_hashed_bayes(
    train: DataFrame,
    num_features: int = HASH_BUCKETS,
    min_df: int = MIN_DOC_FREQ,
    tokenizer: txt.Tokenizer = default_tokens,
) -> PipelineModel:
    """Hashed term frequencies, idf and Naive Bayes of ``train(review, label)``."""
    if train.isEmpty():
        raise EmptyCorpusError("the labelled corpus is empty")
    stages = [
        HashingTF(inputCol="words", outputCol="counts", numFeatures=num_features),
        IDF(inputCol="counts", outputCol="features", minDocFreq=min_df),
        NaiveBayes(labelCol="label", featuresCol="features", modelType="multinomial"),
    ]
    return Pipeline(stages=stages).fit(train.select("label", tokenizer(F.col("review")).alias("words")))


def predict_hashed(
    model: PipelineModel, texts: DataFrame, text: str = "review",
    tokenizer: txt.Tokenizer = default_tokens,
) -> DataFrame:
    """All columns of ``texts`` and ``prediction``."""
    scored = model.transform(texts.select("*", tokenizer(F.col(text)).alias("words")))
    return scored.select(*texts.columns, F.col("prediction").cast("int").alias("prediction"))


# --- evaluation --------------------------------------------------------------


def classification_metrics(predicted: DataFrame) -> DataFrame:
    """``metric, value`` of ``predicted(label, prediction)``, from one confusion count.

    Precision, recall and F1 are weighted by class size; a class that is never
    predicted has precision 0.
    """
    confusion = predicted.groupBy(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))
    nothing = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(nothing)
    both = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), nothing.alias("claimed"),
                 hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), nothing.alias("actual"), F.col("n").alias("claimed"),
                 nothing.alias("hits")),
    )
    per_class = confusion.select(F.inline(both)).groupBy("class").agg(
        F.sum("actual").alias("actual"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    )

    def ratio(part, whole):
        return F.when(whole > 0, part / whole).otherwise(0.0)

    actual, claimed, hits = F.col("actual"), F.col("claimed"), F.col("hits")
    totals = per_class.agg(
        F.sum(actual).alias("size"),
        F.sum(hits).alias("hits"),
        F.sum(actual * ratio(hits, claimed)).alias("precision"),
        F.sum(actual * ratio(hits, actual)).alias("recall"),
        F.sum(actual * ratio(2 * hits, actual + claimed)).alias("f1"),
    )
    size = F.col("size")
    metrics = {
        "accuracy": F.col("hits") / size,
        "precision": F.col("precision") / size,
        "recall": F.col("recall") / size,
        "f1_score": F.col("f1") / size,
        "evaluation_dataset_size": size.cast("double"),
    }
    return totals.filter(size > 0).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.round(value, 6).alias("value"))
        for name, value in metrics.items()
    ])))
