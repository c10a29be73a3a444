"""The gathered feature store: one row per item with all its features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalogue:
    """``rows`` of a store and what is known about them; ``unique`` says that no id occurs twice."""

    rows: DataFrame
    unique: bool
    items: int
    dimensions: dict[str, int]


def one_copy(table: DataFrame) -> DataFrame:
    """Drop whole-row copies; rows are compared by id and two hashes of their content."""
    content = [F.xxhash64(*table.columns), F.hash(*table.columns)]
    keyed = table.select("*", content[0].alias("_content"), content[1].alias("_check"))
    return keyed.dropDuplicates(["id", "_content", "_check"]).drop("_content", "_check")


def gather(tables: Sequence[DataFrame], how: str = "inner", distinct: bool = False) -> DataFrame:
    """Join feature tables on ``id``. Each table is shuffled once; bucketed tables not at all.

    ``how="left"`` keeps items of the first table whose other features are missing. ``distinct``
    drops copies of rows; before the joins, because copies on both sides would multiply.
    """
    parts = [one_copy(t) for t in tables] if distinct else tables
    return reduce(lambda left, right: left.join(right, "id", how), parts)


def write_store(store: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """Save as a table bucketed by id, so later joins on id need no shuffle of the arrays."""
    store.write.mode(mode).bucketBy(buckets, "id").sortBy("id").saveAsTable(table)


def assemble(mean: DataFrame, var: DataFrame, cov: DataFrame, name: str = "features") -> DataFrame:
    """Left-join vector parts and concatenate them; null where a part is missing."""
    joined = mean.join(var, "id", "left").join(cov, "id", "left")
    return joined.select("id", F.concat("mean", "var", "cov").alias(name))


def concatenate(parts: str) -> Column:
    """Concatenated feature vector named like ``"rp+rh"``."""
    names = parts.split("+")
    return F.concat(*names).alias("_".join(names))


def distinct_rows(distances: DataFrame) -> DataFrame:
    """Drop repeated rows of a narrow table."""
    return distances.distinct()


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def id_consistency(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Which ids are missing from which feature tables: one row per incomplete id."""
    names = list(tables)
    tagged = reduce(
        DataFrame.unionByName,
        [df.select("id", *[F.lit(n == name).alias(f"in_{n}") for n in names]) for name, df in tables.items()],
    )
    present = tagged.groupBy("id").agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in names])
    return present.filter(~reduce(lambda a, b: a & b, [F.col(f"in_{n}") for n in names]))
