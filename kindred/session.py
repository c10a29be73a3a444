"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A pair of chroma matrices of 800 beats is 160 KB, so a batch stays near 80 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app_name: str = "kindred", **conf: str) -> SparkSession:
    """Build (or get) a session; master and sizing are left to spark-submit or ``conf``.

    ``conf`` keys use ``__`` for ``.``: ``session(spark__master="local[8]")``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
