"""Query-by-example plans.

All of them measure a narrow table of distances first, cut the plan there, and scale, fuse and
rank that table. They differ in which rows are measured and over which rows bounds are taken:

* ``joined``  - bounds over the items that pass every filter;
* ``feature`` - bounds over each whole feature table, before the results are joined;
* ``refine``  - one distance after another, keeping only rows better than the mean;
* ``prefilter`` - the k best by one distance, then everything on those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.measures import MEASURES, features_of, is_comparable, measure, measure_block, measure_blocks, prepare
from kindred.operators.pairing import QUERY, pair, query_points
from kindred.operators.ranking import SUBSETS, mean_score, nearest, order_columns, top_k, weighted_score
from kindred.operators.scale_out import broadcast_if_small, materialise, small_keys
from kindred.operators.scaling import bounds, scaled, with_bounds
from kindred.operators.store import Catalogue, distinct_rows

# The two recorded refinement orders.
CHROMA_FIRST = ("chroma", "js", "skl", "mfcc", "rp", "rh", "bh", "notes")
BH_FIRST = ("bh", "rh", "notes", "rp", "js", "skl", "mfcc", "chroma")


def _opened(store: DataFrame | Catalogue, distinct: bool | None) -> tuple[DataFrame, bool]:
    """The rows, and whether copies have to be looked for: not in a catalogue that is known to have none."""
    if isinstance(store, Catalogue):
        return store.rows, not store.unique if distinct is None else distinct
    return store, distinct is None or distinct


def _carried(store: DataFrame) -> list[str]:
    return [c for c in ("key", "scale", "bpm") if c in store.columns]


def _chosen(features: str | Sequence[str], weights: Mapping[str, float] | None) -> list[str]:
    """The distances to measure: those with a weight, or the named ones."""
    names = list(SUBSETS[features] if isinstance(features, str) else features)
    if weights is None:
        return names
    unknown = [n for n in weights if n not in names]
    if unknown or not weights:
        raise ValueError(f"weights for distances that are not searched: {unknown}" if unknown else "no weights")
    return [n for n in names if n in weights]


def _usable(rows: DataFrame, names: Sequence[str], limits, missing: str) -> DataFrame:
    """Rows that can be compared by all distances, or by any: then the others become null."""
    comparable = [is_comparable(n, limits) for n in names]
    if missing == "drop":
        return rows.filter(reduce(lambda a, b: a & b, comparable))
    if missing != "keep":
        raise ValueError(f"missing must be 'drop' or 'keep', not {missing!r}")
    some = rows.filter(reduce(lambda a, b: a | b, comparable))
    return some.withColumns({f"d_{n}": F.when(c, F.col(f"d_{n}")) for n, c in zip(names, comparable)})


def _finish(rows: DataFrame, names, weights, k, few, missing: str = "drop") -> DataFrame:
    if missing == "keep":
        weights = weights or dict.fromkeys(names, 1.0)
    score = mean_score(names) if weights is None else weighted_score(weights)
    ranked = rows.withColumn("aggregated", score)
    if k is not None:
        return top_k(ranked, k, few)
    return ranked.orderBy(QUERY, *order_columns())


def _scaled_rows(distances: DataFrame, limits_df: DataFrame, names, carry, few) -> DataFrame:
    return with_bounds(distances, limits_df, few is not None).select(
        QUERY, "id", *carry, *[scaled(n) for n in names]
    )


def measured(
    store: DataFrame, queries: Sequence | DataFrame, names: Sequence[str], limits: Mapping[str, float] | None = None
) -> tuple[DataFrame, list | None]:
    """Distances of every item to every query, and the query ids if they are few."""
    store = prepare(store, names)
    points = query_points(store, queries, features_of(names))
    if points.ids is not None:
        return measure_block(store, points, names, _carried(store), limits), points.ids
    return measure_blocks(store, points, names, _carried(store), limits), points.ids


def search(
    store: DataFrame | Catalogue,
    queries: Sequence | DataFrame,
    features: str | Sequence[str] = "all",
    weights: Mapping[str, float] | None = None,
    limits: Mapping[str, float] | None = None,
    distinct: bool | None = None,
    k: int | None = None,
    missing: str = "drop",
) -> DataFrame:
    """Gathered search: one row per query and comparable item, best first.

    ``distinct`` drops copies of items, which shuffles the narrow distances; it is on unless the store is a catalogue that is known to have none.

    ``features`` names a subset or lists distances; ``weights`` measures and fuses only the distances it names. ``limits``
    replaces the largest comparable value of a distance. ``k`` keeps the best k per query; the default keeps all.
    ``missing="keep"`` also keeps items that lack some distances and scores them over those they have.
    """
    names = _chosen(features, weights)
    store, distinct = _opened(store, distinct)
    distances, few = measured(store, queries, names, limits)
    distances = distinct_rows(distances) if distinct else distances
    cut = materialise(distances, "distances")
    complete = _usable(cut, names, limits, missing)
    rows = _scaled_rows(complete, bounds(complete, names, limits), names, _carried(store), few)
    return _finish(rows, names, weights, k, few, missing)


def join_distances(parts: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    """Narrow distance tables as one, joined on query and item. ``left`` keeps the items of the first, ``full`` those of any table.

    A column that several tables carry is taken from the first that has it.
    """
    seen: set[str] = set()
    kept = []
    for part in parts:
        kept.append(part.select(QUERY, "id", *[c for c in part.columns if c not in seen | {QUERY, "id"}]))
        seen.update(part.columns)
    return reduce(lambda left, right: left.join(right, [QUERY, "id"], how), kept)


def search_tables(
    tables: Sequence[tuple[DataFrame, Sequence[str]]],
    queries: Sequence | DataFrame,
    features: str | Sequence[str] = "all",
    weights: Mapping[str, float] | None = None,
    limits: Mapping[str, float] | None = None,
    distinct: bool = True,
    k: int | None = None,
    missing: str = "drop",
) -> DataFrame:
    """Search separate feature tables, each ``(table, distances it serves)``.

    Every distance is scaled over its whole table. The narrow results meet in one outer join, so
    one table of distances serves both the per-feature bounds and the final inner result.
    """
    names = _chosen(features, weights)
    parts, few, carry = [], [], []
    for table, served in tables:
        wanted = [n for n in served if n in names]
        if wanted:
            part, ids = measured(table, queries, wanted, limits)
            # copies of an item are dropped before the join, where they would multiply
            parts.append(distinct_rows(part) if distinct else part)
            few.append(ids)
            carry += [c for c in _carried(table) if c not in carry]
    wide = join_distances(parts, "full")
    cut = materialise(wide, "distances")
    known = max(few, key=len) if all(f is not None for f in few) else None
    complete = _usable(cut, names, limits, missing)
    rows = _scaled_rows(complete, bounds(cut, names, limits), names, carry, known)
    return _finish(rows, names, weights, k, known, missing)


def better_than_mean(rows: DataFrame, name: str) -> DataFrame:
    """Keep rows strictly better than the mean of their query."""
    d, mean = F.col(f"d_{name}"), F.col(f"mean_{name}")
    return rows.filter(d > mean if MEASURES[name].similarity else d < mean)


def refine(
    store: DataFrame | Catalogue,
    queries: Sequence | DataFrame,
    stages: Sequence[str] = BH_FIRST,
    limits: Mapping[str, float] | None = None,
    min_candidates: int = 0,
) -> DataFrame:
    """Measure one distance after another, on the rows that survived the earlier cuts.

    Neighbouring stages that stay in the JVM are measured in one pass, as their features are small; their cuts follow on the
    narrow table. Survivors are written; those that are few are looked up in the scan, where a store sorted by id is read in part only; otherwise they are broadcast if they are small, so that features of the catalogue are not shuffled.
    A cut that would leave a query fewer than ``min_candidates`` rows is not made.
    """
    store, distinct = _opened(store, None)
    once = distinct_rows if distinct else lambda df: df
    carry, store = _carried(store), prepare(store, stages)
    points = query_points(store, queries, features_of(stages))
    few = points.ids is not None
    survivors, done = None, []
    for run in stage_runs(stages):
        wanted = features_of(run)
        run_points = type(points)(points.df.select(QUERY, *[f"q_{f}" for f in wanted]), points.ids)
        if survivors is None:
            pairs = pair(store.select("id", *carry, *wanted), run_points)
        else:
            rows = _survivors_of(store.select("id", *wanted), survivors, few)
            pairs = rows.join(F.broadcast(run_points.df) if few else run_points.df, QUERY)
        left = materialise(once(measure(pairs, run, [*carry, *done], limits)), "stage")
        for name in run:
            others = [f"d_{n}" for n in run[run.index(name) + 1 :]]
            left = _cut(left.filter(is_comparable(name, limits)), name, limits, few, min_candidates)
            done.append(f"scaled_{name}")
            left = left.select(QUERY, "id", *carry, *done[:-1], *others, scaled(name))
            left = materialise(left, "stage")
        survivors = left
    return survivors.withColumn("aggregated", mean_score(list(stages))).orderBy(QUERY, *order_columns())


def _survivors_of(store: DataFrame, survivors: DataFrame, few: bool = False) -> DataFrame:
    """The rows of the store that survived; the ids of few survivors become a filter that reaches the scan."""
    ids = small_keys(survivors.select("id").distinct(), "id")
    if ids is None:
        return store.join(broadcast_if_small(survivors), "id")
    store = store.filter(F.col("id").isin(ids)) if ids else store.filter("false")
    # At most 512 ids for each of at most 512 queries, a few numbers each.
    return store.join(F.broadcast(survivors) if few else broadcast_if_small(survivors), "id")


def stage_runs(stages: Sequence[str]) -> list[list[str]]:
    """Neighbouring stages measured in one pass: those whose distance stays in the JVM together, others alone."""
    runs: list[list[str]] = []
    for name in stages:
        if runs and MEASURES[name].in_jvm and MEASURES[runs[-1][-1]].in_jvm:
            runs[-1].append(name)
        else:
            runs.append([name])
    return runs


def _cut(rows: DataFrame, name: str, limits, few: bool, min_candidates: int) -> DataFrame:
    """The rows better than the mean, with the bounds of all; a query that would keep too few keeps all."""
    joined = with_bounds(rows, bounds(rows, [name], limits, with_mean=True), few)
    better = better_than_mean(joined, name)
    if not min_candidates:
        return better
    enough = better.groupBy(QUERY).count().filter(F.col("count") >= min_candidates).select(QUERY)
    enough = F.broadcast(enough) if few else enough
    return better.join(enough, QUERY, "left_semi").unionByName(joined.join(enough, QUERY, "left_anti"))


def prefilter(
    store: DataFrame | Catalogue,
    queries: Sequence | DataFrame,
    first: str = "js",
    candidates: int = 25,
    features: str | Sequence[str] = "all",
    limits: Mapping[str, float] | None = None,
) -> DataFrame:
    """All distances on the ``candidates`` best rows of the distance ``first``.

    ``first`` keeps its whole-catalogue scale, the others are scaled over the candidates. At most
    ``candidates`` rows per query go on, so the second pass joins a small table to the store.
    """
    names = list(SUBSETS[features] if isinstance(features, str) else features)
    others = [n for n in names if n != first]
    store, distinct = _opened(store, None)
    once = distinct_rows if distinct else lambda df: df
    carry, store = _carried(store), prepare(store, names)
    quick, few = measured(store.select("id", *features_of([first])), queries, [first], limits)
    cut = materialise(once(quick.filter(is_comparable(first, limits))), "prefilter")
    ranked = with_bounds(cut, bounds(cut, [first], limits), few is not None)
    best = nearest(ranked, candidates, score=f"d_{first}", largest_first=MEASURES[first].similarity)
    best = materialise(best.select(QUERY, "id", scaled(first)), "candidates")
    points = query_points(store, queries, features_of(others))
    rows = store.select("id", *carry, *features_of(others)).join(broadcast_if_small(best), "id")
    pairs = rows.join(F.broadcast(points.df) if points.ids is not None else points.df, QUERY)
    distances = materialise(
        once(measure(pairs, others, [*carry, f"scaled_{first}"], limits)), "distances"
    )
    complete = distances.filter(reduce(lambda a, b: a & b, [is_comparable(n, limits) for n in others]))
    rows = with_bounds(complete, bounds(distances, others, limits), few is not None).select(
        QUERY, "id", *carry, f"scaled_{first}", *[scaled(n) for n in others]
    )
    return _finish(rows, names, None, None, few)
