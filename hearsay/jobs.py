"""The batch steps as commands: clean, preview, explore, learn, drop-columns.

    spark-submit run.py clean --top-level a.csv --replies b.csv --out stored
    spark-submit run.py explore --comments stored --corpus corpus.csv --out results
    spark-submit run.py learn --comments stored --corpus corpus.csv --out results
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators import clean, sentiment
from hearsay.operators.spool import scratch, spool
from hearsay.plans import forecast, learning, report
from hearsay.schemas import IDENTIFIERS
from hearsay.session import get_spark
from hearsay.sources import results, tables


def clean_comments(
    spark: SparkSession,
    top_level_path: str,
    replies_path: str,
    out: str,
    fmt: str = "parquet",
    sub_dir: str | None = None,
    files: int | None = None,
    multi_line: bool = True,
) -> str:
    """Clean and merge the two CSV tables into the stored table; returns its path."""
    with scratch(spark):
        merged = clean.clean_merge(
            tables.read_top_level_csv(spark, top_level_path, multi_line),
            tables.read_replies_csv(spark, replies_path, multi_line),
        )
        return tables.write_stored(clean.to_stored(merged), out, fmt, sub_dir, files)


def preview_comments(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """Print schema and column profile; returns the first ``n`` comments by id."""
    comments = tables.read_stored(spark, path)
    comments.printSchema()
    clean.profile(comments).show(truncate=False)
    return clean.preview(comments, "comment_id", n)


def explore_comments(
    spark: SparkSession, comments_path: str, corpus_path: str, out: str, tz: str | None = None,
    multi_line: bool = True,
) -> dict[str, str]:
    """All exploratory analyses, one dataset each; returns their paths."""
    with scratch(spark):
        corpus = tables.read_corpus_csv(spark, corpus_path, multi_line)
        comments = tables.read_stored(spark, comments_path)
        analyses = report.explore(comments, sentiment.build_lexicon(corpus, keep_common=True), tz=tz, key="row_id")
        return results.write_results(analyses, out)


def learn_sentiment(
    spark: SparkSession,
    comments_path: str,
    corpus_path: str,
    out: str,
    fraction: float = 1.0,
    tz: str | None = None,
    multi_line: bool = True,
) -> dict[str, str]:
    """Train, evaluate and apply the classifier, forecast, and store all of it."""
    with scratch(spark):
        corpus = spool(learning.numbered(tables.read_corpus_csv(spark, corpus_path, multi_line)), "corpus")
        train, test = learning.hash_split(corpus, fraction=fraction)
        model = learning.fit_hashed_bayes(train)
        comments = tables.read_stored(spark, comments_path)
        # Comments are scored once, into the result itself; the trend starts from what is stored.
        scored = learning.predict_hashed(model, comments.select("row_id", "content", "created_at"), "content")
        labels = {results.ANALYSIS: results.comment_labels(scored, carry=["row_id", "created_at"])}
        paths = results.write_results(labels, out)
        stored = spark.read.schema("created_at TIMESTAMP, sentiment_label INT").json(paths[results.ANALYSIS])
        daily = spool(
            forecast.daily_class_counts(stored.withColumnRenamed("sentiment_label", "prediction"), tz), "daily"
        )
        models = {"naive_bayes_model": model, "linear_regression_model": forecast.fit_trend_model(daily)}
        return {
            **paths,
            **results.write_results({
                results.EVALUATION: results.evaluation(
                    learning.classification_metrics(learning.predict_hashed(model, test))
                ),
                results.TREND: forecast.trend_forecast(daily).withColumn(
                    "date", F.date_format("date", "yyyy-MM-dd")
                ),
            }, out),
            **results.write_models(models, f"{out.rstrip('/')}/models"),
        }


def drop_csv_columns(
    spark: SparkSession, source: str, out: str, columns: Sequence[str] = IDENTIFIERS, multi_line: bool = True
) -> list[str]:
    """Copy a CSV without ``columns``; returns the names it did not have."""
    with scratch(spark):
        df = tables.read_csv(spark, source, tables.TOP_LEVEL_SCHEMA, multi_line)
        tables.write_csv(clean.drop_columns(df, columns), out)
        return clean.missing_columns(df, columns)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Public-opinion analytics")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, csv: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        if csv:
            sub.add_argument("--single-line", action="store_true", help="no line breaks inside CSV values")
        return sub

    sub = command("clean", "top-level", "replies", "out")
    sub.add_argument("--format", default="parquet")
    sub.add_argument("--sub-dir")
    sub.add_argument("--files", type=int)
    command("preview", "comments", csv=False).add_argument("--rows", type=int, default=50)
    command("explore", "comments", "corpus", "out").add_argument("--tz")
    sub = command("learn", "comments", "corpus", "out")
    sub.add_argument("--fraction", type=float, default=1.0)
    sub.add_argument("--tz")
    command("drop-columns", "source", "out").add_argument("--columns", nargs="+", default=list(IDENTIFIERS))
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = get_spark(f"hearsay-{args.command}")
    if args.command == "clean":
        print(clean_comments(spark, args.top_level, args.replies, args.out, args.format, args.sub_dir,
                             args.files, not args.single_line))
    elif args.command == "preview":
        preview_comments(spark, args.comments, args.rows).show(args.rows)
    elif args.command == "explore":
        print(explore_comments(spark, args.comments, args.corpus, args.out, args.tz, not args.single_line))
    elif args.command == "learn":
        print(learn_sentiment(spark, args.comments, args.corpus, args.out, args.fraction, args.tz,
                              not args.single_line))
    else:
        print(drop_csv_columns(spark, args.source, args.out, args.columns, not args.single_line))


if __name__ == "__main__":
    main()
