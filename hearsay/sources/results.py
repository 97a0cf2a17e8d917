"""Result sets: one dataset per analysis below one folder, and stored models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANALYSIS, EVALUATION, TREND = (
    "public_opinion_analysis", "algorithm_evaluation", "public_opinion_trend_predictions",
)


def write_results(
    results: Mapping[str, DataFrame], base: str, fmt: str = "json", parallelism: int = 4, compression: str | None = None
) -> dict[str, str]:
    """Write every result under its name, replacing old output; returns the paths.

    ``compression`` (``gzip``) is for results that hold texts.

    The executors write the files, and several results are written at a time, so
    the tail of one job does not leave the cluster idle.
    """
    paths = {name: f"{base.rstrip('/')}/{name}" for name in results}

    def write(name: str) -> None:
        writer = results[name].write.mode("overwrite").format(fmt)
        (writer.option("compression", compression) if compression else writer).save(paths[name])

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for done in [pool.submit(write, name) for name in results]:
            done.result()
    return paths


def write_models(models: Mapping[str, MLWritable], base: str) -> dict[str, str]:
    """Save fitted models under their names, replacing old ones."""
    paths = {name: f"{base.rstrip('/')}/{name}" for name in models}
    for name, model in models.items():
        model.write().overwrite().save(paths[name])
    return paths


def comment_labels(scored: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``carry..., content, date, sentiment_label`` of ``scored(content, created_at, prediction)``."""
    return scored.select(
        *carry, "content",
        F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        F.col("prediction").alias("sentiment_label"),
    )


def evaluation(metrics: DataFrame, model_type: str = "NaiveBayes Classifier") -> DataFrame:
    """``model_type, metric, value`` of ``metrics(metric, value)``."""
    return metrics.select(F.lit(model_type).alias("model_type"), "metric", "value")


def read_results(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schemas[name]).json(path) for name, path in paths.items()}
