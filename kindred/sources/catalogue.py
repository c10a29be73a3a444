"""The list of files and corrections to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.scale_out import broadcast_if_small, running_total

FILES_PER_SHARD = 25


def list_files(spark, pattern: str) -> DataFrame:
    """Paths of all files below a glob, listed in parallel; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")


def inventory(paths: DataFrame, per_shard: int = FILES_PER_SHARD) -> DataFrame:
    """Shard number of every path, in path order, about ``per_shard`` paths each."""
    total = paths.count()
    parts = total // per_shard + 1
    step = total // parts + 1
    rows = running_total(paths.select("path"), [], ["path"])
    return rows.select("path", F.floor((F.col("position") - 1) / step).alias("shard"))


def file_list_lines(shards: DataFrame) -> DataFrame:
    """``path     :       shard`` text lines."""
    return shards.select(F.concat_ws("     :       ", "path", F.col("shard").cast("string")).alias("value"))


def correct_ids(rows: DataFrame, corrections: DataFrame, key: str = "id") -> DataFrame:
    """Replace ids listed in ``corrections(wrong, right)``."""
    fixes = broadcast_if_small(corrections.select(F.col("wrong").alias(key), "right"))
    joined = rows.join(fixes, key, "left")
    return joined.withColumn(key, F.coalesce("right", key)).select(*rows.columns)


def first_n(store: DataFrame, n: int) -> DataFrame:
    """The n first items by id: one subset for all features, found on the ids alone."""
    kept = running_total(store.select("id").distinct(), [], ["id"]).filter(F.col("position") <= n)
    return store.join(kept.select("id"), "id", "left_semi")
