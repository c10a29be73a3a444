"""The eight distances: which feature columns they read and how they are compared."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import correlation, distances, gaussian
from kindred.functions.blocks import against
from kindred.operators.pairing import QUERY, QueryPoints, pair, query_blocks
from kindred.operators.scale_out import scratch_path

# Fixed value: larger Kullback-Leibler divergences are not compared.
KL_LIMIT = 10000.0


@dataclass(frozen=True)
class Measure:
    """``between(item columns, query columns)``; ``similarity`` means larger is closer; ``within`` takes a limit as well and costs less."""

    features: tuple[str, ...]
    between: Callable[..., Column]
    similarity: bool = False
    limit: float | None = None
    in_jvm: bool = False
    within: Callable[..., Column] | None = None


MEASURES: dict[str, Measure] = {
    "rp": Measure(("rp",), distances.euclidean, in_jvm=True),
    "rh": Measure(("rh",), distances.euclidean, in_jvm=True),
    "bh": Measure(("bh",), distances.euclidean, in_jvm=True),
    "notes": Measure(("notes",), distances.edit_distance, in_jvm=True, within=distances.edit_distance_within),
    "chroma": Measure(("chroma",), correlation.chroma_correlation, similarity=True),
    "skl": Measure(
        ("mean", "cov"), lambda *c: gaussian.symmetric_kullback_leibler(*c)["distance"], limit=KL_LIMIT
    ),
    "js": Measure(("mean", "cov"), lambda *c: gaussian.jensen_shannon(*c)["distance"]),
    "mfcc": Measure(("gaussian",), distances.euclidean, in_jvm=True),
}

# Columns computed once per item before it meets the queries.
DERIVED: dict[str, Callable[[], Column]] = {
    "gaussian": lambda: distances.gaussian_vector(F.col("mean"), F.col("cov")),
}


def features_of(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(f for n in names for f in MEASURES[n].features))


def prepare(store: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the derived columns that the distances read."""
    missing = [f for f in features_of(names) if f in DERIVED and f not in store.columns]
    return store.withColumns({f: DERIVED[f]() for f in missing}) if missing else store


def measure(pairs: DataFrame, names: Sequence[str], carry: Sequence[str] = (), limits: dict[str, float] | None = None) -> DataFrame:
    """Project pairs of a prepared store to ids and distances ``d_<name>``; the feature arrays end here.

    ``limits`` are the largest comparable values: a distance that costs less with a bound is null beyond it.
    """
    return pairs.select(QUERY, "id", *carry, *[_between(n, limits).alias(f"d_{n}") for n in names])


# The Arrow functions behind the distances that are measured in Python.
KERNELS = {"chroma": correlation.chroma_correlation, "skl": gaussian.symmetric_kullback_leibler, "js": gaussian.jensen_shannon}


def measure_block(
    store: DataFrame, points: QueryPoints, names: Sequence[str], carry: Sequence[str] = (), limits: dict[str, float] | None = None,
    shared_with: list | None = None,
) -> DataFrame:
    """Like ``measure`` of all pairs, for queries proven few: the arrays of an item go to Python once, not once per query.

    The queries, at most 512 rows and 64 MB by ``query_points``, are a broadcast variable of the kernels, which is added to ``shared_with``.
    """
    in_python = [n for n in names if n in KERNELS]
    if not in_python:
        return measure(pair(store, points), names, carry, limits)
    in_jvm = [n for n in names if n not in KERNELS]
    held = points.df.orderBy(QUERY).toArrow()
    spark = store.sparkSession
    shared = spark.sparkContext.broadcast(held.select([f"q_{f}" for f in features_of(in_python)]))
    if shared_with is not None:
        shared_with.append(shared)
    found = [
        against(KERNELS[n].func, shared, [f"q_{f}" for f in MEASURES[n].features])(*MEASURES[n].features).alias(f"_d_{n}")
        for n in in_python
    ]
    items = store.select("id", *carry, *features_of(in_jvm), *found)
    kind = points.df.schema[QUERY].dataType.simpleString()
    ids = F.array(*[F.lit(i) for i in held[QUERY].to_pylist()]).cast(f"array<{kind}>")
    each = items.select("*", F.posexplode(ids).alias("_at", QUERY))
    each = each.join(F.broadcast(points.df.select(QUERY, *[f"q_{f}" for f in features_of(in_jvm)])), QUERY) if in_jvm else each
    values = {n: F.get(f"_d_{n}", F.col("_at")) for n in in_python} | {n: _between(n, limits) for n in in_jvm}
    return each.select(QUERY, "id", *carry, *[values[n].alias(f"d_{n}") for n in names])


# Blocks of queries whose passes over the catalogue make one job.
BLOCKS_A_JOB = 8


def measure_blocks(
    store: DataFrame, points: QueryPoints, names: Sequence[str], carry: Sequence[str] = (), limits: dict[str, float] | None = None
) -> DataFrame:
    """Like ``measure`` of all pairs, for any number of queries, as a written table.

    Queries are dealt into blocks that may be broadcast, by the running sum of their rows and bytes. Each block is one pass over the catalogue, in which an item's arrays
    go to Python once; neither items nor queries are shuffled, and no copy of either is made but the broadcast ones, which end with their job.
    """
    blocks = query_blocks(points)
    numbers = sorted(r["_block"] for r in blocks.select("_block").distinct().collect())
    paths, schema = [], None
    for at in range(0, max(1, len(numbers)), BLOCKS_A_JOB):
        shared: list = []
        passes = []
        for number in numbers[at : at + BLOCKS_A_JOB] or [0]:
            block = blocks.filter(F.col("_block") == number).drop("_block")
            ids = [r[QUERY] for r in block.select(QUERY).collect()]
            passes.append(measure_block(store, QueryPoints(block, ids), names, carry, limits, shared))
        together = reduce(DataFrame.unionByName, passes)
        paths.append(scratch_path(store.sparkSession, "measured"))
        together.write.parquet(paths[-1])
        schema = together.schema
        for held in shared:
            held.destroy()
    return store.sparkSession.read.schema(schema).parquet(*paths)


def _between(name: str, limits: dict[str, float] | None = None) -> Column:
    m, limit = MEASURES[name], (limits or {}).get(name)
    sides = [*[F.col(f) for f in m.features], *[F.col(f"q_{f}") for f in m.features]]
    return m.between(*sides) if limit is None or m.within is None else m.within(*sides, limit)


def is_comparable(name: str, limits: dict[str, float] | None = None) -> Column:
    """False for missing and infinite distances and those above the limit (NaN sorts above infinity)."""
    limit = (limits or {}).get(name, MEASURES[name].limit)
    d = F.col(f"d_{name}")
    below = d < F.lit(float("inf"))
    return F.coalesce(below if limit is None else below & (d <= limit), F.lit(False))


# The kernels that give a status next to the distance.
WITH_STATUS = {"skl": gaussian.symmetric_kullback_leibler, "js": gaussian.jensen_shannon}


def failures(pairs: DataFrame) -> DataFrame:
    """How the Gaussian divergences of all pairs ended: a row per ``kernel`` with the number of pairs of every status.

    ``pairs`` has ``mean, cov`` and ``q_mean, q_cov``. One pass, so that a user sees why items are missing from a search;
    ``missing`` counts pairs without a summary on one side.
    """
    args = ("mean", "cov", "q_mean", "q_cov")
    both = F.create_map(*[x for name, f in WITH_STATUS.items() for x in (F.lit(name), f(*args))])
    status = F.col("result.status")
    return pairs.select(F.explode(both).alias("kernel", "result")).groupBy("kernel").agg(
        *[F.count_if(status == s).alias(s) for s in ("ok", "negative", "nan", "not_positive_definite")],
        F.count_if(status.isNull()).alias("missing"), F.count("*").alias("pairs"),
    )
