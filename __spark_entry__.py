"""

Every query reads the test tables of ``sf_dir`` through the views of
``hearsay.fixtures`` and runs over all of their rows.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml import PipelineModel  # noqa: E402
from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.ml.regression import LinearRegressionModel  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hearsay import fixtures as fx  # noqa: E402
from hearsay import jobs  # noqa: E402
from hearsay.functions import clock  # noqa: E402
from hearsay.operators import clean, lookup, sentiment  # noqa: E402
from hearsay.operators.spool import fresh_path, portions, scratch, spool  # noqa: E402
from hearsay.plans import forecast, han, interaction, learning, opinion, report, volume, words  # noqa: E402
from hearsay.schemas import COUNT_COLUMNS  # noqa: E402
from hearsay.sources import json_lines, records, results, tables  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from hearsay.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not missing.name.startswith("hearsay.llm"):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"

CLEAN_COLUMNS = (
    "comment_id", "created_at", "content", "likes", "comments", "shares", "ip_location", "gender",
)


# --- cleaning, sources and sinks ---------------------------------------------


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_stored(clean.clean_merge(*fx.raw_levels(spark, sf_dir)))


def clean_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_analysis(_clean(spark, sf_dir)).select(*CLEAN_COLUMNS)


def stored_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_stored(_clean(spark, sf_dir), fresh_path(spark, "stored"), sub_dir="cleaned")
    return tables.read_stored(spark, path).select(*CLEAN_COLUMNS)


def null_drop_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_drop_audit(*fx.raw_levels(spark, sf_dir, texts=False))


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.profile(fx.figures(spark, sf_dir))


def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rank ids first, then fetch the texts of the five rows found.
    first = clean.preview(fx.comments(spark, sf_dir).select("comment_id", "created_at", "likes", "doc_id"), "comment_id", 5)
    found = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(F.broadcast(first), "doc_id")
    return found.select("comment_id", "created_at", "content", "likes")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    top_level, _ = fx.raw_levels(spark, sf_dir)
    text_time = F.date_format("create_date_time", "yyyy-MM-dd HH:mm:ssXXX")
    tables.write_csv(top_level.withColumn("create_date_time", text_time), path, compression="gzip")
    raw = tables.read_top_level_csv(spark, path)
    typed = clean.to_analysis(clean.to_stored(clean.drop_columns(raw, ["user_id"])))
    return typed.select(
        F.col("comment_id").cast("bigint").alias("comment_id"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"), *CLEAN_COLUMNS[2:],
    )


#: Texts that are written as plain CSV at once, in bytes.
CSV_BYTES = 1 << 30


def csv_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks and quotes inside values, and a value whose quote is never closed, read by splits.

    Only plain files have splits, and as plain CSV all texts take many times their space: portions of the
    rows are written, read and kept as typed rows in turn.
    """
    top_level, _ = fx.raw_levels(spark, sf_dir)
    rows = top_level.select("comment_id", "content", F.col("liked_count").alias("likes"))
    nation = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    head = F.when(F.col("n_nationkey") == 0, F.concat(F.lit(f'{",".join(rows.columns)}\n-1,"open ""said"" '), "n_name"))
    read = fresh_path(spark, "spread")
    with scratch(spark):
        joined = spool(rows, "rows", "zstd")
        for at, portion in enumerate(portions(joined, F.octet_length("content"), CSV_BYTES)):
            with scratch(spark):
                path = fresh_path(spark, "csv")
                tables.write_csv(portion, path)
                if at == 0:
                    nation.select("n_nationkey", F.coalesce(head, "n_name").alias("value")).repartition(1).sortWithinPartitions(
                        "n_nationkey").select("value").write.mode("append").text(path)
                found = records.read_spread(spark, path, rows.schema, tables.CSV_OPTIONS)
                found.write.mode("append").parquet(read, compression="zstd")
    return spark.read.schema(rows.schema).parquet(read)


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which the first is broken, arrays on a line, and arrays and objects over many lines."""
    path = fresh_path(spark, "json")
    rows = fx.figures(spark, sf_dir).select("comment_id", F.to_date("created_at").alias("date"), "ip_location", "likes")
    rows = rows.withColumn("ip_location", F.concat(F.lit('{["\\'), "ip_location", F.lit('"}, {\t')))
    one, listed = F.struct("*"), F.collect_list(F.struct(*rows.columns))
    part = lambda k: rows.filter(F.pmod("comment_id", F.lit(4)) == k)
    groups = lambda k: part(k).groupBy(F.floor(F.col("comment_id") / 50)).agg(listed.alias("rows"))
    pretty = {"pretty": "true"}
    broken = F.when(F.col("comment_id") % 400 == 0, '{"ip_location": "no end\n').otherwise("")
    for at, lines in enumerate((
        part(0).select(F.concat(broken, F.to_json(one)).alias("value")), groups(1).select(F.to_json("rows").alias("value")),
        part(2).select(F.to_json(one, pretty).alias("value")), groups(3).select(F.to_json("rows", pretty).alias("value")),
    )):
        lines.write.text(f"{path}/kind={at}")
    return json_lines.read_tolerant(spark, path, rows.schema)


def json_tolerant_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "json")
    rows = fx.figures(spark, sf_dir).select(
        "comment_id", F.to_date("created_at").alias("date"), "ip_location", "likes"
    )
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    broken = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit('{"ip_location": "'), "n_name"))
    lines.union(broken).write.text(path)
    return json_lines.read_tolerant(spark, path, rows.schema)


# --- volume and interaction --------------------------------------------------


def _on_comments(analysis: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, sf_dir: analysis(fx.figures(spark, sf_dir), **params)


def posts_per_hour_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The test tables are in UTC, while times without a zone count as session time.
    in_session = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "created_at")
    comments = fx.figures(spark, sf_dir).withColumn("created_at", in_session)
    return volume.posts_per_hour(comments, tz="Asia/Shanghai")


def top_share_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rank without texts; only the ten rows found are looked up and labelled.
    top = interaction.top_conversion(fx.comments(spark, sf_dir), 10, carry=["doc_id"])
    found = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(F.broadcast(top), "doc_id")
    labelled = sentiment.label_sentiment(
        found, _scoring_lexicon(spark, sf_dir), fx.NEGATIONS, carry=["content", "share_conversion_rate"]
    )
    return labelled.select("comment_id", "content", "sentiment", "share_conversion_rate")


# --- words and sentiment -----------------------------------------------------


def _lexicon(spark: SparkSession, sf_dir: str, min_freq: int = 1) -> DataFrame:
    return sentiment.build_lexicon(fx.corpus(spark, sf_dir), min_freq)


def _scoring_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the words of both classes: as known neutral words they are never shuffled."""
    return spool(sentiment.build_lexicon(fx.corpus(spark, sf_dir), keep_common=True), "lexicon")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.token_counts(fx.texts(spark, sf_dir), fx.STOP_WORDS)


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(fx.texts(spark, sf_dir), "content")


def corpus_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.class_word_counts(fx.corpus(spark, sf_dir))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir).select("word", "polarity")


def lexicon_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir, min_freq=3).select("word", "polarity")


def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.label_sentiment(
        fx.texts(spark, sf_dir), _scoring_lexicon(spark, sf_dir), fx.NEGATIONS
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Labels and figures are both narrow: no text takes part in this join.
    labels = sentiment_labels(spark, sf_dir).withColumnRenamed("comment_id", "doc_id")
    return fx.comments(spark, sf_dir).join(labels, "doc_id")


def _on_labelled(analysis: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, sf_dir: analysis(_labelled(spark, sf_dir), **params)


def frequent_words_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.frequent_words(
        fx.texts(spark, sf_dir), _lexicon(spark, sf_dir), n=50, stop_words=fx.STOP_WORDS
    )


def high_conversion_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.high_conversion(fx.figures(spark, sf_dir), share=0.1).select("comment_id")


def high_conversion_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 95 of 100 comments have one rate."""
    shares = F.when(F.col("comment_id") % 20 == 1, F.col("shares")).otherwise(0)
    tied = fx.figures(spark, sf_dir).withColumn("shares", shares)
    return interaction.high_conversion(tied, share=0.1).select("comment_id")


def conversion_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The condition needs figures only, so just the rows that pass it are joined to texts.
    high = interaction.high_conversion(fx.comments(spark, sf_dir), share=0.1)
    found = fx.with_texts(spark, sf_dir, high.select("comment_id", "doc_id"))
    return words.top_words(found, n=50, stop_words=fx.STOP_WORDS)


# --- learning and forecasts --------------------------------------------------


def _all_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.texts(spark, sf_dir).withColumnsRenamed({"comment_id": "doc_id", "content": "review"})


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return learning.key_split(fx.corpus(spark, sf_dir), "doc_id")


def nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split(spark, sf_dir)
    return learning.predict_bayes(learning.fit_bayes(train), _all_reviews(spark, sf_dir))


def nb_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    predicted = learning.predict_bayes(learning.fit_bayes(train), test)
    return learning.classification_metrics(predicted.join(test.select("doc_id", "label"), "doc_id"))


def _predicted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.comments(spark, sf_dir).join(nb_predictions(spark, sf_dir), "doc_id")


def daily_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.daily_class_counts(_predicted_comments(spark, sf_dir))


def trend_history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.history_range(daily_class_counts(spark, sf_dir))


def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.trend_forecast(daily_class_counts(spark, sf_dir))


def trend_forecast_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.trend_forecast(daily_class_counts(spark, sf_dir), feature="row")


def _sampled_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return learning.hash_split(spool(fx.corpus(spark, sf_dir), "corpus"), ["doc_id"], fraction=0.7)


def sampled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _sampled_split(spark, sf_dir)
    part = lambda df, name: df.select("doc_id", F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


def nb_hashed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on words hashed to buckets, in closed form."""
    train, _ = _sampled_split(spark, sf_dir)
    model = learning.fit_bayes(train, tokenizer=fx.hashed_words, size=fx.BUCKETS)
    return learning.predict_bayes(model, _all_reviews(spark, sf_dir), tokenizer=fx.hashed_words)


def nb_hashed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pipeline's predictions, from words that are its buckets already."""
    train, _ = _sampled_split(spark, sf_dir)
    model = learning.fit_hashed_bayes(train, num_features=1 << 18, tokenizer=fx.hashed_words)
    scored = learning.predict_hashed(model, _all_reviews(spark, sf_dir), tokenizer=fx.hashed_words)
    return scored.select("doc_id", "prediction")


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled, and how many of them otherwise after the model was stored and read."""
    train, _ = _sampled_split(spark, sf_dir)
    model = learning.fit_hashed_bayes(train)
    paths = results.write_models({"naive_bayes_model": model}, fresh_path(spark, "models"))
    reviews = _all_reviews(spark, sf_dir)
    both = learning.predict_hashed(PipelineModel.load(paths["naive_bayes_model"]), learning.predict_hashed(
        model, reviews).withColumnRenamed("prediction", "before"))
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("prediction") != F.col("before")).alias("changed"))


def trend_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = volume.posts_per_day(fx.figures(spark, sf_dir)).withColumnRenamed("count", "positive_count")
    paths = results.write_models(
        {"linear_regression_model": forecast.fit_trend_model(daily)}, fresh_path(spark, "models")
    )
    model = LinearRegressionModel.load(paths["linear_regression_model"])
    day = F.datediff("date", daily.agg(F.min("date")).scalar()).alias("days_since_start")
    vectors = VectorAssembler(inputCols=["days_since_start"], outputCol="features")
    fitted = model.transform(vectors.transform(daily.select("date", day)))
    return fitted.select("date", F.round("prediction", 6).alias("fitted_count"))


# --- Chinese texts -----------------------------------------------------------


def _han_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool(sentiment.build_lexicon(fx.han_corpus(spark, sf_dir), keep_common=True), "lexicon")


def han_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.token_counts(fx.han_texts(spark, sf_dir))


def han_sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.label_sentiment(fx.han_texts(spark, sf_dir), _han_lexicon(spark, sf_dir))


def han_frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.frequent_words(fx.han_texts(spark, sf_dir), _han_lexicon(spark, sf_dir), n=50)


def _han_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool(han.run_counts(fx.han_corpus(spark, sf_dir).withColumnRenamed("review", "content")), "runs")


def _han_words(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    return spool(han.discover(fx.han_corpus(spark, sf_dir).withColumnRenamed("review", "content"), runs=runs), "han-words")


def han_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _han_words(spark, sf_dir)


def han_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _han_runs(spark, sf_dir)
    found = _han_words(spark, sf_dir, runs)
    cut = han.segmented(fx.han_texts(spark, sf_dir), found, cuts=han.frequent_cuts(runs, found))
    return cut.select("comment_id", F.array_join("words", " ").alias("words"))


def han_word_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment by a lexicon of found words: corpus and comments are cut along the same paths."""
    runs = _han_runs(spark, sf_dir)
    found = _han_words(spark, sf_dir, runs)
    cuts = han.frequent_cuts(runs, found)
    # Cut twice: written once, or joined to the labels, words take several times the space of their texts.
    reviews = han.segmented(fx.han_corpus(spark, sf_dir).withColumnRenamed("review", "content"), found, "doc_id", carry=["label"], cuts=cuts)
    lexicon = sentiment.build_lexicon(reviews.withColumnRenamed("words", "review"), keep_common=True, tokenizer=han.segmented_words)
    cut = han.segmented(fx.han_texts(spark, sf_dir), found, cuts=cuts).withColumnRenamed("words", "content")
    return sentiment.label_sentiment(cut, spool(lexicon, "lexicon"), tokenizer=han.segmented_words)


# --- the other side of the bounded lookup ------------------------------------

SMALL_BOUND = lookup.Bound(rows=100)


def sentiment_labels_small_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.label_sentiment(
        fx.texts(spark, sf_dir), _scoring_lexicon(spark, sf_dir), fx.NEGATIONS, bound=SMALL_BOUND
    )


def nb_predictions_small_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split(spark, sf_dir)
    return learning.predict_bayes(learning.fit_bayes(train), _all_reviews(spark, sf_dir), bound=SMALL_BOUND)


def nb_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three classes of the lexicon, learned from four fifths of the documents."""
    labels = sentiment_labels(spark, sf_dir).select(F.col("comment_id").alias("doc_id"), F.col("sentiment").alias("label"))
    labels = spool(labels, "labels")  # read twice: for the classes, and with the texts
    reviews = _all_reviews(spark, sf_dir)
    train, _ = learning.key_split(reviews.join(labels, "doc_id"), "doc_id")
    return learning.predict_classes(learning.fit_classes(train), reviews)


# --- percentiles from sketches ---------------------------------------------------


def percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day from stored sketches, and whether their ranks among all comments are within 0.01."""
    comments = fx.figures(spark, sf_dir)
    stored = spool(interaction.sketches(comments, rank_error=0.005), "sketches")
    marks = interaction.percentiles_of_sketches(stored, p=0.9)
    values = comments.select(clock.day(F.col("created_at")).alias("date"), *COUNT_COLUMNS).unpivot(
        "date", list(COUNT_COLUMNS), "metric", "number").filter("number IS NOT NULL")
    ranked = values.join(marks, ["date", "metric"]).groupBy("date", "metric", "n").agg(
        F.count("*").alias("all"), F.count_if(F.col("number") < F.col("value")).alias("below"),
        F.count_if(F.col("number") <= F.col("value")).alias("up_to"))
    near = (F.col("below") <= 0.91 * F.col("all")) & (F.col("up_to") >= 0.89 * F.col("all"))
    return ranked.select("date", "metric", "n", near.alias("within"))


# --- complete result sets ----------------------------------------------------

_TEXT = ("string", "date", "timestamp", "timestamp_ntz")


def _long_rows(name: str, df: DataFrame) -> DataFrame:
    """``name, key, column, number``: the text columns of a row, by name, are its key."""
    keys = sorted(c for c, kind in df.dtypes if kind in _TEXT)
    key = F.concat_ws("|", F.lit("k"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys])
    numbers = [F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), 6).alias("number"))
               for c in sorted(df.columns) if c not in keys]
    return df.select(F.lit(name).alias("name"), key.alias("key"), F.inline(F.array(*numbers)))


def _stored_rows(spark: SparkSession, datasets: dict[str, DataFrame], folder: str) -> DataFrame:
    """Everything that was written, read back."""
    paths = results.write_results(datasets, fresh_path(spark, folder))
    stored = results.read_results(spark, paths, {name: df.schema for name, df in datasets.items()})
    return reduce(DataFrame.unionByName, [_long_rows(name, df) for name, df in stored.items()])


def results_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyses = report.explore(
        fx.comments(spark, sf_dir),
        sentiment.build_lexicon(fx.corpus(spark, sf_dir), keep_common=True),
        fx.STOP_WORDS, fx.NEGATIONS, fx.ALIASES,
        texts=fx.texts(spark, sf_dir).withColumnRenamed("comment_id", "doc_id"),
    )
    return _stored_rows(spark, analyses, "results")


def learning_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    predicted = spool(learning.predict_bayes(learning.fit_bayes(train), _all_reviews(spark, sf_dir)), "predicted")
    scored = fx.comments(spark, sf_dir).select("created_at", "doc_id").join(predicted, "doc_id")
    metrics = learning.classification_metrics(test.select("doc_id", "label").join(predicted, "doc_id"))
    labels = results.comment_labels(fx.with_texts(spark, sf_dir, scored))
    paths = results.write_results({results.ANALYSIS: labels}, fresh_path(spark, "learning"), compression="gzip")
    stored = results.read_results(spark, paths, {results.ANALYSIS: labels.schema})[results.ANALYSIS]
    per_day = stored.groupBy("date", F.col("sentiment_label").cast("string").alias("sentiment_label")).agg(
        F.count("*").alias("rows"), F.sum(F.char_length("content")).alias("chars"))
    others = {
        results.EVALUATION: results.evaluation(metrics),
        results.TREND: forecast.trend_forecast(forecast.daily_class_counts(scored.select("created_at", "prediction"))),
    }
    return _long_rows(results.ANALYSIS, per_day).unionByName(_stored_rows(spark, others, "learning"))


# --- the jobs, from CSV files to CSV files and tables -------------------------


def _text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("create_date_time", F.date_format("create_date_time", "yyyy-MM-dd HH:mm:ssXXX"))


def clean_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both raw tables as CSV, through the cleaning job."""
    paths = [fresh_path(spark, name) for name in ("top", "replies", "cleaned")]
    for level, path in zip(fx.raw_levels(spark, sf_dir), paths):
        tables.write_csv(_text_time(level), path, compression="gzip")
    stored = jobs.clean_comments(spark, *paths)
    names = ("created_at", "content", "likes", "comments", "shares", "ip_location", "gender")
    return tables.read_stored(spark, stored).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")).select(*names)


def corpus_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of a corpus that went through CSV."""
    path = fresh_path(spark, "corpus")
    tables.write_csv(fx.corpus(spark, sf_dir).select("review", "label"), path)
    return sentiment.build_lexicon(tables.read_corpus_csv(spark, path)).select("word", "polarity")


# --- contract ----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: sentiment of all comments per day."""
    return queries()["sentiment_over_time"](spark, SMOKE_DIR)


def _llm_queries() -> dict[str, Query]:
    if llm_queries is None:
        return {}
    return {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}


def queries() -> dict[str, Query]:
    return {
        "clean_merge": clean_merge,
        "stored_roundtrip": stored_roundtrip,
        "null_drop_audit": null_drop_audit,
        "table_profile": table_profile,
        "table_preview": table_preview,
        "csv_roundtrip": csv_roundtrip,
        "csv_spread": csv_spread,
        "json_tolerant_read": json_tolerant_read,
        "json_documents": json_documents,
        "posts_per_hour": _on_comments(volume.posts_per_hour),
        "posts_per_hour_local": posts_per_hour_local,
        "posts_per_day": _on_comments(volume.posts_per_day),
        "event_peak": _on_comments(volume.event_peak),
        "event_stages": _on_comments(volume.event_stages),
        "ip_location_counts": _on_comments(volume.ip_location_counts),
        "province_post_counts": _on_comments(volume.province_post_counts, aliases=fx.ALIASES),
        "gender_ratio": _on_comments(volume.gender_ratio),
        "interaction_per_gender": _on_comments(interaction.interaction_per_gender),
        "posts_per_user_by_gender": _on_comments(volume.posts_per_user_by_gender),
        "interaction_p99": _on_comments(interaction.percentiles, p=0.99),
        "extreme_likes_count": _on_comments(interaction.extreme_count, threshold=10_000),
        "shares_by_location": _on_comments(interaction.shares_by_location),
        "avg_share_conversion": _on_comments(interaction.average_share_conversion),
        "top_share_conversion": top_share_conversion,
        "top_opinion_leaders": _on_comments(interaction.top_users, n=100),
        "tokens": tokens,
        "word_count": word_count,
        "corpus_word_counts": corpus_word_counts,
        "lexicon": lexicon,
        "lexicon_min_freq": lexicon_min_freq,
        "sentiment_labels": sentiment_labels,
        "sentiment_overall": _on_labelled(opinion.sentiment_counts),
        "sentiment_hot": _on_labelled(opinion.sentiment_counts, min_likes=opinion.HOT_LIKES),
        "sentiment_by_gender": _on_labelled(opinion.sentiment_by, key="gender"),
        "sentiment_by_location": _on_labelled(opinion.sentiment_by, key="ip_location"),
        "sentiment_over_time": _on_labelled(opinion.sentiment_over_time),
        "frequent_words_sentiment": frequent_words_sentiment,
        "conversion_top_words": conversion_top_words,
        "high_conversion_ids": high_conversion_ids,
        "high_conversion_ties": high_conversion_ties,
        "nb_predictions": nb_predictions,
        "nb_evaluation": nb_evaluation,
        "daily_class_counts": daily_class_counts,
        "trend_history_range": trend_history_range,
        "trend_forecast": trend_forecast,
        "trend_forecast_row": trend_forecast_row,
        "hourly_interaction_forecast": _on_comments(forecast.hourly_forecast),
        "sampled_split": sampled_split,
        "nb_hashed_buckets": nb_hashed_buckets,
        "nb_hashed_pipeline": nb_hashed_pipeline,
        "model_roundtrip": model_roundtrip,
        "trend_model_roundtrip": trend_model_roundtrip,
        "results_bundle": results_bundle,
        "learning_bundle": learning_bundle,
        "han_tokens": han_tokens,
        "han_sentiment_labels": han_sentiment_labels,
        "han_frequent_words": han_frequent_words,
        "han_words": han_words,
        "han_segments": han_segments,
        "han_word_sentiment": han_word_sentiment,
        "sentiment_labels_small_bound": sentiment_labels_small_bound,
        "nb_predictions_small_bound": nb_predictions_small_bound,
        "nb_three_classes": nb_three_classes,
        "percentiles_by_day": percentiles_by_day,
        # Days of the test tables are much alike: low marks let them have waves.
        "event_waves": _on_comments(volume.event_waves, ratio=1.03, price=0.1),
        "clean_from_csv": clean_from_csv,
        "corpus_from_csv": corpus_from_csv,
        **_llm_queries(),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for every query; of the training-data operators for those that SQL can express."""
    from oracle_queries import SQL

    extra = dict(llm_queries.SQL) if llm_queries else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**SQL, **extra}
