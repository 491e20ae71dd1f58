"""Settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "folioscope", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf (dots as __) goes on top."""
    builder = SparkSession.builder.appName(app)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
