"""A session with settings that suit the engine; what a cluster has set is left alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: adaptive execution coalesces and splits partitions at run time, so the number of shuffle partitions is only where it starts
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """The running session or a new one; ``conf`` may name any setting with ``__`` for a dot."""
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
