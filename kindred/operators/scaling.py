"""Min-max scaling and statistics per query.

Bounds are one aggregate with map-side combine, joined back to the rows: no window ever holds a
whole catalogue in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.measures import MEASURES, is_comparable
from kindred.operators.pairing import QUERY
from kindred.operators.scale_out import broadcast_if_small


def statistics(distances: DataFrame, names: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and sample standard deviation of every distance, in one pass."""
    return distances.groupBy(QUERY).agg(
        *[
            f(f"d_{n}").alias(f"{label}_{n}")
            for n in names
            for label, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("stddev", F.stddev_samp))
        ]
    )


def bounds(
    distances: DataFrame,
    names: Sequence[str],
    limits: dict[str, float] | None = None,
    with_mean: bool = False,
) -> DataFrame:
    """Smallest and largest comparable value per query (and the mean, for refining)."""
    aggregates = []
    for n in names:
        value = F.when(is_comparable(n, limits), F.col(f"d_{n}"))
        aggregates += [F.min(value).alias(f"min_{n}"), F.max(value).alias(f"max_{n}")]
        if with_mean:
            aggregates.append(F.avg(value).alias(f"mean_{n}"))
    return distances.groupBy(QUERY).agg(*aggregates)


def scaled(name: str) -> Column:
    """``(d - min) / (max - min)``, inverted for a similarity; null when all values are equal."""
    low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
    unit = F.try_divide(F.col(f"d_{name}") - low, high - low)
    return (1 - unit if MEASURES[name].similarity else unit).alias(f"scaled_{name}")


def with_bounds(distances: DataFrame, limits_df: DataFrame, few_queries: bool) -> DataFrame:
    """Attach per-query bounds, one row each. Those of queries that were not proven few are written and counted first."""
    return distances.join(F.broadcast(limits_df) if few_queries else broadcast_if_small(limits_df, computed=True), QUERY)
