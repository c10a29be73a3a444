"""Building blocks that keep every operator inside bounded tasks.

* ``materialise`` cuts a plan at a written table, so a frame that is read twice is computed once
  and a lost executor costs only its own tasks.
* ``small_keys`` proves that a frame is small before anything is broadcast.
* ``running_total`` numbers or accumulates rows inside groups of any size: a hot group is spread
  over range partitions instead of being sorted by one task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DateType, NumericType, StringType, StructType, TimestampType,
)

BROADCAST_ROWS = 512
BROADCAST_BYTES = 64 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        # Executors of local-cluster are processes of their own, perhaps without the driver's folders.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="kindred-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/kindred-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(value: Column | str, dtype: DataType) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    if isinstance(dtype, ArrayType):
        if isinstance(dtype.elementType, NumericType):
            return F.coalesce(F.size(value) * 8, F.lit(0))
        sizes = F.transform(value, lambda x: bytes_of(x, dtype.elementType).cast("long"))
        return F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    if isinstance(dtype, StructType):
        return sum((bytes_of(value[f.name], f.dataType) for f in dtype.fields), F.lit(16))
    if isinstance(dtype, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(dtype, (NumericType, BooleanType, DateType, TimestampType)):
        return F.lit(16)
    return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) * 4 + 64


def small_keys(
    df: DataFrame, key: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> list | None:
    """The keys of ``df`` if it is proven to fit ``max_rows`` and ``max_bytes``, else ``None``.

    Reads at most ``max_rows + 1`` keys and sizes, never the rows themselves.
    """
    size = sum((bytes_of(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    rows = df.select(F.col(key).alias("key"), size.alias("bytes")).take(max_rows + 1)
    if len(rows) > max_rows or sum(r["bytes"] for r in rows) > max_bytes:
        return None
    return [r["key"] for r in rows]


def broadcast_if_small(
    df: DataFrame, computed: bool = False, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only for a frame whose size was checked; otherwise leave the join to Spark.

    ``computed`` says that ``df`` is expensive: it is materialised, so the check does not repeat it.
    """
    df = materialise(df, "lookup") if computed else df
    head = df.limit(max_rows + 1)
    size = sum((bytes_of(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    row = head.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    if row["n"] > max_rows or (row["bytes"] or 0) > max_bytes:
        return df
    return F.broadcast(df)


def running_total(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    value: Column | None = None,
    name: str = "position",
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` (default 1, so the row number) within each group.

    ``group_by + order_by`` must be unique. Rows are range-partitioned on both, so a group that
    holds a third of the table is cut into many partitions. Each partition sums locally; the
    totals of the earlier partitions of the same group, one row per (partition, group), are added.
    ``totals`` names sums over the whole group, which travel with those rows, so that a hot group never meets on its key.
    """
    group_by, order_by = list(group_by), list(order_by)
    totals = totals or {}
    cut = materialise(
        df.withColumn("_value", F.lit(1) if value is None else value)
        .withColumns({f"_sum_{n}": c for n, c in totals.items()})
        .repartitionByRange(*[F.col(c) for c in group_by + order_by])
        .withColumn("_part", F.spark_partition_id()),
        "running",
    )
    part_keys = ["_part", *group_by]
    local = Window.partitionBy(*part_keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_by)
    offsets = (
        cut.groupBy(*part_keys)
        .agg(F.sum("_value").alias("_total"), *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in totals])
        .select(
            *part_keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
            *[F.sum(f"_sum_{n}").over(whole).alias(n) for n in totals],
        )
    )
    offsets = broadcast_if_small(offsets, computed=True)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in part_keys]
    summed = cut.withColumn("_local", F.sum("_value").over(local))
    return summed.alias("l").join(offsets.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("r._before")).alias(name),
        *[F.col(f"r.{n}") for n in totals],
    )


def exact_median(df: DataFrame, group_by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group for groups of any size.

    Equal values are counted first; the running count then finds the one or two middle values.
    """
    group_by = list(group_by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group_by, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, group_by, [value], F.col("_n"), "_upto", {"_all": F.col("_n")})
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    holds = [(F.col("_upto") - F.col("_n") < edge) & (edge <= F.col("_upto")) for edge in (low, high)]
    return (
        ranked.filter(holds[0] | holds[1])
        .groupBy(*group_by)
        .agg((F.min(F.when(holds[0], F.col(value))) / 2 + F.max(F.when(holds[1], F.col(value))) / 2).alias(name))
    )
