"""Scores, order and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.measures import MEASURES
from kindred.operators.pairing import QUERY
from kindred.operators.scale_out import running_total

# The named feature subsets.
SUBSETS: dict[str, tuple[str, ...]] = {
    "all": ("rp", "rh", "bh", "notes", "chroma", "skl", "js", "mfcc"),
    "fast": ("notes", "rh", "mfcc"),
    "precise": ("chroma", "rp", "js"),
    "notes_mfcc_rp": ("notes", "mfcc", "rp"),
    "notes_rh": ("notes", "rh"),
    "notes_rp_chroma_mfcc_skl_bh": ("notes", "rp", "chroma", "mfcc", "skl", "bh"),
}

# Digits to which scores and ranked distances are told apart.
DECIMALS = 9


def mean_score(names: Sequence[str]) -> Column:
    """Plain mean of the scaled distances; null if one of them is null."""
    return sum((F.col(f"scaled_{n}") for n in names[1:]), F.col(f"scaled_{names[0]}")) / len(names)


def weighted_score(weights: Mapping[str, float]) -> Column:
    """``sum(w*d) / sum(w)`` over the distances that are present."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        d = F.col(f"scaled_{name}")
        total += F.when(d.isNotNull(), d * F.lit(float(w))).otherwise(0.0)
        weight += F.when(d.isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.try_divide(total, weight)


def order_columns(score: str = "aggregated", largest_first: bool = False) -> list[Column]:
    """The score (nulls last), then the id as tie-break.

    Fused scores, which lie between 0 and 1, are equal if they agree to nine decimals: the order of summation decides the digits
    beyond, and it differs from run to run. Distances have no such scale and are compared as they are.
    """
    value = F.round(score, DECIMALS) if score == "aggregated" else F.col(score)
    return [value.desc_nulls_last() if largest_first else value.asc_nulls_last(), F.asc("id")]


def nearest(
    rows: DataFrame, k: int, by: Sequence[str] = (QUERY,), score: str = "aggregated", largest_first: bool = False
) -> DataFrame:
    """The k best rows of each group with their ``position``.

    The rank filter lets Spark cut each task to k rows per group before the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(*order_columns(score, largest_first))
    return rows.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)


def top_k(rows: DataFrame, k: int, few_queries: list | None) -> DataFrame:
    """Best k rows per query; a single query needs only a bounded heap per task."""
    if few_queries is not None and len(few_queries) == 1:
        return rows.orderBy(*order_columns()).limit(k)
    return nearest(rows, k).drop("position")


def ranked_lists(distances: DataFrame, names: Sequence[str]) -> DataFrame:
    """The unscaled ranking of every distance over the whole catalogue, in one pass.

    Distances become rows; a similarity sorts with its sign turned. Positions come from range
    partitions of (query, feature, distance), so one long list is not sorted by one task. Equality
    is judged at nine decimals, then by id.
    """
    turned = {n: -1.0 if MEASURES[n].similarity else 1.0 for n in names}
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("feature"),
                    F.col(f"d_{n}").alias("distance"),
                    F.round(F.col(f"d_{n}") * turned[n], DECIMALS).alias("_order"),
                )
                for n in names
            ]
        )
    )
    rows = distances.select(QUERY, "id", stacked.alias("_d")).select(QUERY, "id", "_d.*")
    return running_total(rows, [QUERY, "feature"], ["_order", "id"]).drop("_order")
