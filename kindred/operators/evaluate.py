"""Retrieval quality of a batch search.

Input is one long table ``(query_id, id, query_class, class, scaled_*)``. All feature combinations
are scored in one pass, and only the k best rows per query and combination are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.pairing import QUERY
from kindred.operators.ranking import mean_score, nearest
from kindred.operators.scale_out import broadcast_if_small

# The combinations compared for genres and for cover versions.
GENRE_COMBINATIONS = (
    "mfcc+skl+rp", "rp+rh+bh+mfcc+skl+js", "mfcc+skl", "mfcc+rp", "mfcc", "skl", "mfcc+skl+js", "js", "js+mfcc",
    "js+rp", "skl+rp",
)
COVER_COMBINATIONS = (
    "chroma+notes+rp", "mfcc+notes+rp", "notes", "chroma+notes", "chroma", "notes+rp", "chroma+js", "chroma+mfcc",
    "chroma+rp", "chroma+js+rp", "chroma+mfcc+rp", "chroma+js+rp+rh+bh+skl+notes+mfcc", "rp", "mfcc+js+skl",
    "chroma+skl", "chroma+skl+rp",
)


def with_classes(results: DataFrame, classes: DataFrame) -> DataFrame:
    """Attach the class of the item and of the query."""
    queries = results.select(QUERY).distinct()
    of_queries = classes.select(F.col("id").alias(QUERY), F.col("class").alias("query_class")).join(queries, QUERY, "left_semi")
    return results.join(classes.select("id", "class"), "id").join(broadcast_if_small(of_queries, computed=True), QUERY)


def rescore(results: DataFrame, combos: Sequence[str]) -> DataFrame:
    """One row per combination: the plain mean of its scaled distances."""
    scores = F.array(*[F.struct(F.lit(c).alias("combination"), mean_score(c.split("+")).alias("newdist")) for c in combos])
    kept = [c for c in results.columns if not c.startswith("scaled_")]
    return results.select(*kept, F.explode(scores).alias("s")).select(*kept, "s.combination", "s.newdist")


def neighbours(scored: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every query and combination, the query itself left out."""
    others = scored.filter(F.col(QUERY) != F.col("id"))
    return nearest(others, k, by=("combination", QUERY), score="newdist")


def class_votes(found: DataFrame) -> DataFrame:
    """How often each class is found per query."""
    return found.groupBy("combination", QUERY, "query_class", "class").agg(F.count("*").alias("found"))


def confusion(found: DataFrame) -> DataFrame:
    """``(true, found) -> count`` over all queries."""
    return found.groupBy("combination", F.col("query_class").alias("true_class"), F.col("class").alias("found_class")).agg(
        F.count("*").alias("count")
    )


def confusion_matrix(found: DataFrame, classes: Sequence) -> DataFrame:
    """One column per found class, and ``other`` for neighbours of a class that is not listed."""
    cells = [F.count_if(F.col("class").eqNullSafe(F.lit(c))).alias(str(c)) for c in classes]
    other = F.count_if(~F.coalesce(F.col("class").isin(list(classes)), F.lit(False))).alias("other")
    return found.groupBy("combination", F.col("query_class").alias("true_class")).agg(*cells, other)


def hits(found: DataFrame) -> DataFrame:
    """Neighbours of the query's own class, per class and combination."""
    return (
        found.filter(F.col("class") == F.col("query_class"))
        .groupBy("combination", "query_class")
        .agg(F.count("*").alias("hits"))
    )


def precision(found: DataFrame) -> DataFrame:
    same = (F.col("class") == F.col("query_class")).cast("double")
    return found.groupBy("combination").agg(F.avg(same).alias("precision"), F.count("*").alias("neighbours"))


def correlations(results: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregate, in long form."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = results.agg(*[F.corr(columns[a], columns[b]).alias(f"{a}|{b}") for a, b in pairs])
    both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                 F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`").alias("correlation"))
        for a, b in sorted(both)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
