"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits skewed ones at run time, so
# the shuffle width only has to be large enough for the biggest job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(app_name: str = "hearsay", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
