"""A catalogue with the widths of real feature files, generated by Spark; every value follows from the id. For the bench only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.scale_out import materialise

ITEMS = 10_000
DIM = 13


def _unit(*of: Column) -> Column:
    """A number from 0 to 1 that depends on the given columns."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 20)).cast("double") / (1 << 20)


def _vector(n: int | Column, salt: int) -> Column:
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda j: _unit(F.col("id"), j, F.lit(salt)))


def catalogue(spark: SparkSession, items: int = ITEMS) -> DataFrame:
    """``items`` rows: 1,750 vector values, a Gaussian of 13 dimensions, 500 to 799 symbols and pitch matrices of 500 to 899 beats."""
    i, j = (lambda k: F.floor(k / DIM)), (lambda k: k % DIM)
    # Symmetric, its diagonal larger than the rest of a line together, hence positive definite.
    cell = lambda k: _unit(F.col("id"), F.least(i(k), j(k)), F.greatest(i(k), j(k))) / DIM + F.when(i(k) == j(k), 1.0).otherwise(0.0)
    symbols = F.transform(F.sequence(F.lit(0), (F.col("id") % 300).cast("int") + 499), lambda k: F.chr(F.floor(_unit(F.col("id"), k, F.lit(5)) * 12) + 65))
    rows = spark.range(items).repartition(spark.sparkContext.defaultParallelism * 4, "id").select(
        "id", _vector(1440, 1).alias("rp"), _vector(60, 2).alias("rh"), _vector(250, 3).alias("bh"), _vector(DIM, 4).alias("mean"),
        F.transform(F.sequence(F.lit(0), F.lit(DIM * DIM - 1)), cell).alias("cov"), F.array_join(symbols, "").alias("notes"),
        _vector(12 * (500 + F.col("id") % 400), 6).alias("chroma"),
    )
    return materialise(rows, "trial")
