"""Retrieval evaluation on the result of the batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.frame import rounded
from checks.registry import Registry
from checks.searching import ALL, _result
from kindred.functions.ids import class_from_path
from kindred.operators import evaluate as E
from kindred.operators.pairing import QUERY

check = Registry()

COMBOS = [*E.GENRE_COMBINATIONS, *[c for c in E.COVER_COMBINATIONS if c not in E.GENRE_COMBINATIONS]]

_CLASSED = """classed as (select scaled.*, v.class, w.class as query_class from scaled
    join vec v on v.id = scaled.id join vec w on w.id = scaled.query_id)"""


def _rescored(combos) -> str:
    parts = [
        f"select query_id, id, class, query_class, '{c}' as combination, {S.mean_score(c.split('+'))} as newdist from classed"
        for c in combos
    ]
    return "rescored as (" + " union all ".join(parts) + ")"


def _found(combos, k: int) -> str:
    return S.RESULT.rstrip() + ", " + ", ".join([_CLASSED, _rescored(combos), f"""found as (select *,
        row_number() over (partition by combination, query_id order by newdist, id) as position from rescored
        where query_id <> id qualify position <= {k})"""]) + "\n"


def _classed(spark, sf) -> DataFrame:
    return E.with_classes(_result(spark, sf), I.vec(spark, sf).select("id", "class"))


def _neighbours(spark, sf, combos, k: int) -> DataFrame:
    return E.neighbours(E.rescore(_classed(spark, sf), combos), k)


@check("e1_path_class", r"select page_id, split_part(regexp_replace(url, 'https?://[^/]*/', ''), '/', 1) as class from pages")
def e1_path_class(spark, sf):
    path = F.regexp_replace("url", "https?://[^/]*/", "music/")
    return I.table(spark, sf, "pages").select("page_id", class_from_path(path).alias("class"))


@check("e2_combinations", S.RESULT.rstrip() + f", {_CLASSED}, {_rescored(COMBOS)} select query_id, id, combination, round(newdist, 6) + 0.0 as newdist from rescored")
def e2_combinations(spark, sf):
    return rounded(E.rescore(_classed(spark, sf), COMBOS).select(QUERY, "id", "combination", "newdist"))


@check("e3_neighbours", _found(COMBOS, 10) + "select combination, query_id, id, position, round(newdist, 6) + 0.0 as newdist from found")
def e3_neighbours(spark, sf):
    found = _neighbours(spark, sf, COMBOS, 10)
    return rounded(found.select("combination", QUERY, "id", F.col("position").cast("long").alias("position"), "newdist"))


@check("e4_class_votes", _found(E.GENRE_COMBINATIONS, 10) + "select combination, query_id, query_class, class, count(*) as found from found group by all")
def e4_class_votes(spark, sf):
    return E.class_votes(_neighbours(spark, sf, E.GENRE_COMBINATIONS, 10))


@check("e5_confusion", _found(E.GENRE_COMBINATIONS, 10) + "select combination, query_class as true_class, class as found_class, count(*) as count from found group by all")
def e5_confusion(spark, sf):
    return E.confusion(_neighbours(spark, sf, E.GENRE_COMBINATIONS, 10))


@check("e5_confusion_matrix", _found(E.GENRE_COMBINATIONS, 10) + "select combination, query_class as true_class, "
       + ", ".join(f'count(*) filter (class = {c}) as "{c}"' for c in range(8)) + ", count(*) filter (class is null or class not in (0, 1, 2, 3, 4, 5, 6, 7)) as other from found group by all")
def e5_confusion_matrix(spark, sf):
    return E.confusion_matrix(_neighbours(spark, sf, E.GENRE_COMBINATIONS, 10), range(8))


def _hits_sql(k: int) -> str:
    return _found(E.COVER_COMBINATIONS, k) + "select combination, query_class, count(*) as hits from found where class = query_class group by all"


@check("e6_hits_at_1", _hits_sql(1))
def e6_hits_at_1(spark, sf):
    return E.hits(_neighbours(spark, sf, E.COVER_COMBINATIONS, 1))


@check("e6_hits_at_5", _hits_sql(5))
def e6_hits_at_5(spark, sf):
    return E.hits(_neighbours(spark, sf, E.COVER_COMBINATIONS, 5))


@check("e7_precision", _found(COMBOS, 10) + "select combination, round(avg((class = query_class)::int), 6) + 0.0 as precision, count(*) as neighbours from found group by all")
def e7_precision(spark, sf):
    return rounded(E.precision(_neighbours(spark, sf, COMBOS, 10)))


@check("e9_correlations", S.RESULT + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, round(corr(scaled_{a}, scaled_{b}), 6) + 0.0 as correlation from scaled"
    for a in ALL for b in ALL))
def e9_correlations(spark, sf):
    return rounded(E.correlations(_result(spark, sf), {n: f"scaled_{n}" for n in ALL}))
