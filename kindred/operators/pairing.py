"""Bring every query together with every catalogue row, whatever the number of queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.scale_out import BROADCAST_BYTES, BROADCAST_ROWS, bytes_of, materialise, running_total, small_keys

QUERY = "query_id"
# Catalogue rows that one task holds against a block of queries.
LANE_ROWS = 2000


@dataclass(frozen=True)
class QueryPoints:
    """The example rows; ``ids`` is set only when the frame is proven small."""

    df: DataFrame
    ids: list | None


def query_points(
    catalogue: DataFrame, queries: Sequence | DataFrame, features: Sequence[str], max_rows: int = BROADCAST_ROWS
) -> QueryPoints:
    """Look up the queries; ``queries`` is a list of ids, a frame with an ``id`` column, or
    ``catalogue`` itself when it holds nothing but queries.

    A short list becomes a filter that reaches the scan, where row groups and buckets without these
    ids are skipped. The rows found are written once, so that no later step reads the catalogue
    for them again. Features are renamed ``q_<feature>``.
    """
    wanted = queries
    if isinstance(queries, DataFrame) and queries is not catalogue:
        listed = queries.select("id").distinct()
        known = small_keys(listed, "id", max_rows)
        wanted = listed if known is None else known
    if wanted is catalogue:
        found = catalogue
    elif isinstance(wanted, DataFrame):
        found = catalogue.join(wanted, "id", "left_semi")
    else:
        found = catalogue.filter(F.col("id").isin(list(wanted)))
    points = found.select(F.col("id").alias(QUERY), *[F.col(f).alias(f"q_{f}") for f in features])
    # Of several rows with one id the one with the smallest hash of its features is the example.
    first = F.struct(F.xxhash64(*[f"q_{f}" for f in features]).alias("_hash"), *[f"q_{f}" for f in features])
    one = points.groupBy(QUERY).agg(F.min_by(first, first["_hash"]).alias("_p")).select(QUERY, *[f"_p.q_{f}" for f in features])
    points = materialise(one, "queries")
    return QueryPoints(points, small_keys(points, QUERY, max_rows))


def query_blocks(points: QueryPoints) -> DataFrame:
    """``points`` with ``_block``: queries dealt so that no block has more rows or bytes than may be broadcast (a single larger query is a block of its own)."""
    size = sum((bytes_of(f.name, f.dataType) for f in points.df.schema.fields), F.lit(0))
    part = F.greatest(F.lit(1.0) / BROADCAST_ROWS, size / F.lit(float(BROADCAST_BYTES)))
    sizes = running_total(points.df.select(QUERY, part.alias("_part")), [], [QUERY], F.col("_part"), "_upto")
    block = sizes.select(QUERY, F.greatest(F.ceil(F.round("_upto", 9)), F.lit(1)).cast("int").alias("_block"))
    return materialise(points.df.join(block, QUERY), "blocks")


def pair(catalogue: DataFrame, points: QueryPoints, lanes: int | None = None) -> DataFrame:
    """Each catalogue row once per query.

    A proven small set of queries is broadcast: the rows stay where they are and nothing is
    shuffled. Otherwise queries fall into blocks and rows into lanes, and each (block, lane) meets
    in one bounded task of an ordinary equi-join.
    """
    if points.ids is not None:
        kind = points.df.schema[QUERY].dataType
        ids = F.array(*[F.lit(i) for i in points.ids]).cast(f"array<{kind.simpleString()}>")
        return catalogue.withColumn(QUERY, F.explode(ids)).join(F.broadcast(points.df), QUERY)
    lanes = lanes or max(1, ceil(catalogue.count() / LANE_ROWS))
    blocks = max(1, ceil(points.df.count() / BROADCAST_ROWS))
    spread = catalogue.withColumn("_lane", F.pmod(F.xxhash64("id"), F.lit(lanes))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    placed = points.df.withColumn("_block", F.pmod(F.hash(QUERY), F.lit(blocks))).withColumn(
        "_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    )
    return spread.join(placed, ["_block", "_lane"]).drop("_block", "_lane")
