"""A session with the settings that the library is made for; clusters set their own master and memory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow. partitions: of shuffles; by default Spark's, which adaptive execution coalesces."""
    builder = SparkSession.builder.appName("ordinalis")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
    } | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    return builder.config(map=settings | conf).getOrCreate()
