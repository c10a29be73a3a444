"""Distances, scaling, ranking and whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.frame import rounded
from checks.registry import Registry
from kindred.functions import correlation as C
from kindred.operators import lsh, ranking, scaling
from kindred.operators import store as feature_store
from kindred.operators.measures import failures, is_comparable
from kindred.operators.pairing import QUERY, pair, query_points
from kindred.operators.scale_out import materialise, running_total
from kindred.plans import search as plans

ALL = list(S.NAMES)
check = Registry()


def _tables(spark, sf):
    return [
        (I.vec(spark, sf), ["rp", "rh", "bh"]),
        (I.gauss(spark, sf), ["mfcc", "skl", "js"]),
        (I.notes(spark, sf), ["notes"]),
        (I.chroma(spark, sf), ["chroma"]),
    ]


def _distances(store: DataFrame, queries, names) -> DataFrame:
    """Measured once and cut, for operators that read the distances twice."""
    return materialise(plans.measured(store, queries, names)[0], "distances")


def _scaled(store: DataFrame, queries, names) -> DataFrame:
    measured, few = plans.measured(store, queries, names)
    d = materialise(measured, "distances")
    for n in names:
        d = d.filter(is_comparable(n))
    d = scaling.with_bounds(d, scaling.bounds(d, names), few_queries=few is not None)
    return d.select(QUERY, "id", *[scaling.scaled(n) for n in names])


def _result(spark, sf) -> DataFrame:
    return _scaled(I.stored(spark, sf), I.query_list(spark, sf), ALL)


# --- distances ---------------------------------------------------------------------------------
_ONE = S.with_(S.VEC)


@check("f1_lookup", S.with_(S.VEC) + "select id, class, round(rp[1], 6) + 0.0 as rp_1 from vec where id = 0")
def f1_lookup(spark, sf):
    found = I.vec(spark, sf).filter(F.col("id") == 0)
    return rounded(found.select("id", "class", F.element_at("rp", 1).alias("rp_1")))


@check("f2_attach", S.with_(S.NOTES) + """select s.id, length(s.notes) as own, length(q.notes) as compared
from notes s, notes q where q.id = 0""")
def f2_attach(spark, sf):
    notes = I.notes(spark, sf)
    pairs = pair(notes, query_points(notes, [0], ["notes"]))
    return pairs.select("id", F.length("notes").cast("long").alias("own"), F.length("q_notes").cast("long").alias("compared"))


@check("d1_euclid", _ONE + f"""select s.id, {', '.join(f'round({S.euclid(n)}, 6) + 0.0 as d_{n}' for n in ('rp', 'rh', 'bh'))}
from vec s, vec q where q.id = 0""")
def d1_euclid(spark, sf):
    return rounded(plans.measured(I.vec(spark, sf), [0], ["rp", "rh", "bh"])[0].drop(QUERY))


@check("knn_euclid", _ONE + f"""select s.id, round({S.euclid('rp')}, 6) + 0.0 as d_rp from vec s, vec q where q.id = 0
order by {S.euclid('rp')}, s.id limit 10""")
def knn_euclid(spark, sf):
    d = plans.measured(I.vec(spark, sf), [0], ["rp"])[0]
    return rounded(d.orderBy(*ranking.order_columns("d_rp")).limit(10).drop(QUERY))


_GAUSS = S.with_(S.GAUSS)


@check("d2_gaussian_euclid", _GAUSS + f"select s.id, round({S.MFCC}, 6) + 0.0 as d_mfcc from gauss s, gauss q where q.id = 0")
def d2_gaussian_euclid(spark, sf):
    return rounded(plans.measured(I.gauss(spark, sf), [0], ["mfcc"])[0].drop(QUERY))


@check("d3_kullback_leibler", _GAUSS + f"select s.id, round({S.SKL}, 6) + 0.0 as d_skl from gauss s, gauss q where q.id = 0")
def d3_kullback_leibler(spark, sf):
    return rounded(plans.measured(I.gauss(spark, sf), [0], ["skl"])[0].drop(QUERY))


@check("d4_jensen_shannon", _GAUSS + f"select s.id, round({S.JS}, 6) + 0.0 as d_js from gauss s, gauss q where q.id = 0")
def d4_jensen_shannon(spark, sf):
    return rounded(plans.measured(I.gauss(spark, sf), [0], ["js"])[0].drop(QUERY))


@check("d5_levenshtein", S.with_(S.NOTES) + f"select s.id, {S.LEVENSHTEIN} as d_notes from notes s, notes q where q.id = 0")
def d5_levenshtein(spark, sf):
    return plans.measured(I.notes(spark, sf), [0], ["notes"])[0].drop(QUERY)


@check("d6_chroma_correlation", S.with_(S.CHROMA) + f"""select id, round({S.chroma_correlation('lags')}, 6) + 0.0 as d_chroma
from (select s.id, {S.LAGS} as lags from chroma s, chroma q where q.id = 0)""")
def d6_chroma_correlation(spark, sf):
    return rounded(plans.measured(I.chroma(spark, sf), [0], ["chroma"])[0].drop(QUERY))


def _correlated(spark, sf, kernel) -> DataFrame:
    table = I.chroma_var(spark, sf)
    pairs = pair(table, query_points(table, [0], ["chroma"]))
    return rounded(pairs.select("id", kernel("chroma", "q_chroma").alias("d_chroma")))


# One fact for all two-dimensional variants: chroma_var as rows (id, line, beat, value).
def _cells(time_major: bool) -> str:
    line, beat = ("i % 12", "i // 12") if time_major else ("i // n", "i % n")
    return f"""cells as (select id, n, {line} as line, {beat} as beat, value from (select id, n, i, coalesce(embedding[(i + 1)::int]::double, 0) as value
    from (select vec_id as id, 6 + vec_id % 4 as n, unnest(range(12 * (6 + vec_id % 4))) as i, embedding from embeddings)))"""


def _full(time_major: bool, longest_first: bool, lines: str) -> str:
    """CTEs up to ``full_corr(id, m, n, line, lag, c)``; m and n are the lengths of the fixed and moved matrix."""
    swap = "s.n <= q.n" if longest_first else "false"
    return f"""{_cells(time_major)},
sides as (select s.id, case when {swap} then 0 else s.id end as a, case when {swap} then s.id else 0 end as v,
    case when {swap} then q.n else s.n end as m, case when {swap} then s.n else q.n end as n
    from (select distinct id, n from cells) s, (select distinct n from cells where id = 0) q),
full_corr as (select p.id, p.m, p.n, x.line - y.line + 11 as line, x.beat - y.beat + p.n - 1 as lag,
    sum(x.value * y.value) as c from sides p join cells x on x.id = p.a join cells y on y.id = p.v
    where {lines} group by all)"""


def _same(lines: str = "true") -> str:
    return f"same_corr as (select * from full_corr where {lines} and lag >= n // 2 and lag < n // 2 + m)"


def _filtered(source: str) -> str:
    """Unrolled recurrence over at most 17 lags, as a join of each lag with the earlier ones."""
    return f"""steps as (select *, c - coalesce(lag(c) over (partition by id order by lag), first_c) as step
    from (select *, {source} from picked)),
responses as (select a.id, a.lag, sum(0.8632712640 * pow(0.7265425280, a.lag - b.lag) * b.step) as y
    from steps a join steps b on a.id = b.id and b.lag <= a.lag group by all)
select id, round(max(y), 6) + 0.0 as d_chroma from responses group by id"""


_OFFSET = "first_value(c) over (partition by id order by lag) as first_c"

check("d7_correlation_maximum_same", S.with_(_full(False, True, "true"), _same("line between 6 and 17"))
      + "select id, round(max(c), 6) + 0.0 as d_chroma from same_corr group by id")(
    lambda spark, sf: _correlated(spark, sf, C.correlation_maximum_same))

check("d8_correlation_peak_line", S.with_(
    _full(True, True, "true"),
    "peak as (select id, arg_max(line, c) as line from full_corr group by id)",
    "picked as (select id, lag, c from full_corr join peak using (id, line))",
).rstrip() + ", " + _filtered("0.0 as first_c"))(
    lambda spark, sf: _correlated(spark, sf, C.correlation_peak_line))

check("d9_correlation_fixed_line", S.with_(_full(True, False, "x.line - y.line = 1"))
      + "select id, round(max(c), 6) + 0.0 as d_chroma from full_corr group by id")(
    lambda spark, sf: _correlated(spark, sf, C.correlation_fixed_line))

check("d10_correlation_maximum_full", S.with_(_full(True, False, "true"))
      + "select id, round(max(c), 6) + 0.0 as d_chroma from full_corr group by id")(
    lambda spark, sf: _correlated(spark, sf, C.correlation_maximum_full))

check("d13_correlation_per_length", S.with_(_full(True, True, "x.line - y.line = 1"), _same())
      + "select id, round(max(c / n), 6) + 0.0 as d_chroma from same_corr group by id")(
    lambda spark, sf: _correlated(spark, sf, C.correlation_per_length))

check("d14_correlation_unshifted", S.with_(
    _full(False, True, "x.line = y.line"), _same(), "picked as (select id, lag, c from same_corr)",
).rstrip() + ", " + _filtered(_OFFSET))(
    lambda spark, sf: _correlated(spark, sf, C.correlation_unshifted))


@check("d6_chroma_lengths", S.with_(
    _full(False, True, "x.line = y.line"),
    "picked as (select id, lag, c from full_corr where lag >= (n - 1) // 2 and lag < (n - 1) // 2 + m)",
).rstrip() + ", " + _filtered(_OFFSET))
def d6_chroma_lengths(spark, sf):
    return _correlated(spark, sf, C.chroma_correlation)


# Cell widths of about 1.7 deviations of the projections, and the share of the rows that a query is held against.
_RP_WIDTH, _MFCC_WIDTH, _SHARE, _SEARCH_SHARE = 0.21, 5.8, 0.2, 0.3


def _shared(feature: str, dim: int, source: str, width: float) -> list[str]:
    """CTE ``shared_<feature>``: in how many tables a row stands in a bucket that the query asks."""
    vector = f"s.{feature}" if feature != "mfcc" else "[s.m1, s.m2, s.c11, s.c12, s.c22]"
    bits = lambda what: f"('0x' || substr(md5('{lsh.SEED}:' || i || ':' || {what}), 1, 8))::bigint"
    return [
        f"""planes_{feature} as (select i, list(v order by j) as plane, {bits("'offset'")} / 4294967296::double as off
            from (select i, j, {bits('j')} / 2147483648::double - 1 as v from range({lsh.TABLES * lsh.PER_TABLE}) a(i), range({dim}) b(j)) group by i)""",
        f"""cells_{feature} as (select id, i, floor(y) as c, floor(y) + case when y - floor(y) < 0.5 then -1 else 1 end as near from (
            select s.id, i, list_dot_product({vector}, plane) / sqrt(list_dot_product(plane, plane)) / {width}::double + off as y
            from {source} s, planes_{feature}))""",
        f"""shared_{feature} as (select query_id, id, count(*) as shared from (
            select q.id as query_id, s.id, s.i // {lsh.PER_TABLE} as t from cells_{feature} s join cells_{feature} q using (i)
            where q.id in (select id from queries) and (s.c = q.c or s.c = q.near) group by all having count(*) = {lsh.PER_TABLE}) group by all)""",
    ]


def _candidates(shared: str, source: str, share: float) -> str:
    """CTE ``candidates``: whole levels of shared tables within a share of the rows, and the first level."""
    return f"""candidates as (select query_id, id from (
        select *, count(*) over (partition by query_id order by shared desc) as upto, max(shared) over (partition by query_id) as most from {shared})
        where upto <= {share} * (select count(*) from {source}) or shared = most)"""


_RP_INDEX = [S.VEC, *_shared("rp", 40, "vec", _RP_WIDTH)]
_PAIRS = f"select p.query_id, s.id, round({S.euclid('rp')}, 6) + 0.0 as distance from {{}} p join vec s on s.id = p.id join vec q on q.id = p.query_id"
_FIFTIETH = "queries as (select vec_id as id from embeddings where vec_id % 50 = 0)"


@check("d11_lsh_neighbours", S.with_(S.QUERY_ZERO, *_RP_INDEX, _candidates("shared_rp", "vec", _SHARE)) + f"""
select id, distance from ({_PAIRS.format('candidates')} order by {S.euclid('rp')}, s.id limit 10)""")
def d11_lsh_neighbours(spark, sf):
    return rounded(lsh.approximate_neighbours(I.vec(spark, sf), 0, "rp", k=10, bucket_length=_RP_WIDTH, share=_SHARE))


@check("d12_lsh_join", S.with_(S.QUERY_LIST, *_RP_INDEX) + _PAIRS.format("shared_rp") + f" where {S.euclid('rp')} < 8.0")
def d12_lsh_join(spark, sf):
    table = I.vec(spark, sf)
    points = table.join(I.query_list(spark, sf), "id", "left_semi")
    return rounded(lsh.approximate_join(table, points, "rp", threshold=8.0, bucket_length=_RP_WIDTH))


@check("d12_lsh_join_close", S.with_(_FIFTIETH, *_RP_INDEX, _candidates("shared_rp", "vec", _SHARE)) + _PAIRS.format("candidates")
       + f" where {S.euclid('rp')} < 0.9")
def d12_lsh_join_close(spark, sf):
    table = I.vec(spark, sf)
    return rounded(lsh.approximate_join(table, table.filter("id % 50 = 0"), "rp", threshold=0.9, bucket_length=_RP_WIDTH, share=_SHARE))


@check("p8_lsh_search", S.with_(
    S.FEATURES, S.QUERY_ZERO, *_shared("mfcc", 5, "store", _MFCC_WIDTH), *_shared("rp", 40, "store", _RP_WIDTH),
    "together as (select query_id, id, sum(shared) as shared from (from shared_mfcc union all from shared_rp) group by all)",
    _candidates("together", "store", _SEARCH_SHARE),
) + f"""select query_id, id, {S.rounded(['mfcc', 'rp', 'notes'], 'scaled_')},
round((scaled_mfcc + scaled_rp + scaled_notes) / 3, 6) + 0.0 as aggregated from (select query_id, id,
{', '.join(f"(d_{n} - min(d_{n}) over ()) / nullif(max(d_{n}) over () - min(d_{n}) over (), 0) as scaled_{n}" for n in ('mfcc', 'rp', 'notes'))}
from (select p.query_id, s.id, {S.MFCC} as d_mfcc, {S.euclid('rp')} as d_rp, {S.LEVENSHTEIN} as d_notes
from candidates p join store s on s.id = p.id join store q on q.id = p.query_id))""")
def p8_lsh_search(spark, sf):
    table = feature_store.gather([I.vec(spark, sf), I.notes(spark, sf), I.gauss(spark, sf)])
    widths = {"mfcc": _MFCC_WIDTH, "rp": _RP_WIDTH}
    return rounded(lsh.approximate_search(table, 0, ("mfcc", "rp"), ("notes",), widths, share=_SEARCH_SHARE))


# --- gathering ---------------------------------------------------------------------------------
_SHAPE = """id, len(rp) + len(rh) + len(bh) as n_vec, round(m1, 6) + 0.0 as m1, coalesce(length(notes), 0) as n_notes,
    round(chroma[1], 6) + 0.0 as chroma_1"""


def _shape(df: DataFrame) -> DataFrame:
    n_vec = F.size("rp") + F.size("rh") + F.size("bh")
    return rounded(df.select(
        "id", n_vec.cast("long").alias("n_vec"), F.element_at("mean", 1).alias("m1"),
        F.coalesce(F.length("notes"), F.lit(0)).cast("long").alias("n_notes"), F.element_at("chroma", 1).alias("chroma_1"),
    ))


@check("j1_gather", S.with_(S.FEATURES) + f"select {_SHAPE} from store")
def j1_gather(spark, sf):
    return _shape(I.store(spark, sf))


@check("j2_gather_left", S.with_(S.VEC, S.GAUSS, S.NOTES, S.CHROMA) + f"""select {_SHAPE}
from vec left join gauss using (id) left join notes using (id) left join chroma using (id)""")
def j2_gather_left(spark, sf):
    return _shape(feature_store.gather([f(spark, sf) for f in (I.vec, I.gauss, I.notes, I.chroma)], "left"))


_LEFT_STORE = """store as (select * from vec left join gauss using (id) left join notes using (id) left join chroma using (id))"""
_SEEN = ["rp", "notes", "mfcc"]


@check("j2_search_left", S.with_(
    S.VEC, S.GAUSS, S.NOTES, S.CHROMA, _LEFT_STORE, S.QUERY_ZERO, S.distances(),
    f"found as (select *, {', '.join(f'min(d_{n}) over () as min_{n}, max(d_{n}) over () as max_{n}' for n in _SEEN)} from dist)",
    f"scaled as (select query_id, id, {', '.join(f'{S.scaled(n)} as scaled_{n}' for n in _SEEN)} from found)",
) + f"""select id, {S.rounded(_SEEN, 'scaled_')}, round(list_avg(list_filter([{', '.join(f'scaled_{n}' for n in _SEEN)}], lambda x: x is not null)), 6) + 0.0 as aggregated
from scaled""")
def j2_search_left(spark, sf):
    """Items without a Gaussian or notes stay, scored over what they have."""
    left = feature_store.gather([f(spark, sf) for f in (I.vec, I.gauss, I.notes, I.chroma)], "left")
    return rounded(plans.search(left, [0], _SEEN, missing="keep").drop(QUERY))


@check("j6_assemble", S.with_(S.VEC) + """select id, case when class < 5 then 64 else 0 end::bigint as n,
case when class < 5 then round(rp[1], 6) + 0.0 end as first, case when class < 5 then round(bh[12], 6) + 0.0 end as last
from vec where class <> 0""")
def j6_assemble(spark, sf):
    table = I.vec(spark, sf)
    mean = table.filter(F.col("class") != 0).select("id", F.col("rp").alias("mean"))
    var = table.filter(F.col("class") < 5).select("id", F.col("rh").alias("var"))
    cov = table.select("id", F.col("bh").alias("cov"))
    out = feature_store.assemble(mean, var, cov)
    features = F.col("features")
    return rounded(out.select(
        "id", F.when(features.isNotNull(), F.size(features)).otherwise(0).cast("long").alias("n"),
        F.element_at(features, 1).alias("first"), F.element_at(features, -1).alias("last")))


@check("a7_duplicate_ids", "select text as id, count(*) as copies from documents group by text having count(*) > 1")
def a7_duplicate_ids(spark, sf):
    return feature_store.duplicate_ids(I.table(spark, sf, "documents").select(F.col("text").alias("id")))


@check("a8_id_consistency", S.with_(S.VEC, S.GAUSS, S.NOTES) + """select id, id in (select id from vec) as in_vec,
id in (select id from gauss) as in_gauss, id in (select id from notes) as in_notes
from (select id from vec union select id from gauss union select id from notes)
where not (in_vec and in_gauss and in_notes)""")
def a8_id_consistency(spark, sf):
    return feature_store.id_consistency({"vec": I.vec(spark, sf), "gauss": I.gauss(spark, sf), "notes": I.notes(spark, sf)})


# --- filters, statistics, scaling --------------------------------------------------------------
_DIST0 = S.with_(S.FEATURES, S.QUERY_ZERO, S.distances())
_DIST = S.with_(S.FEATURES, S.QUERY_LIST, S.distances())
_D = ", ".join(f"round(d_{n}, 6) + 0.0 as d_{n}" for n in ALL)


@check("f3_threshold", _GAUSS + f"""select * from (select s.id, round({S.SKL}, 6) + 0.0 as d_skl from gauss s, gauss q
where q.id = 0) where d_skl <= 0.05""")
def f3_threshold(spark, sf):
    d = plans.measured(I.gauss(spark, sf), [0], ["skl"])[0]
    return rounded(d.filter(is_comparable("skl", {"skl": 0.05})).drop(QUERY))


_BAD = S.with_(S.GAUSS, S.GAUSS_BAD)
_HEALTHY = "s.c11 > 0 and s.c11*s.c22 - s.c12*s.c12 > 0"


@check("f4_infinity", _BAD + f"""select s.id, round({S.JS}, 6) + 0.0 as d_js
from (select * from gauss_bad s where {_HEALTHY}) s, gauss_bad q where q.id = 0""")
def f4_infinity(spark, sf):
    d = plans.measured(I.gauss_bad(spark, sf), [0], ["js"])[0]
    return rounded(d.filter(is_comparable("js")).drop(QUERY))


@check("a9_failures", _BAD + f"""select k.kernel, count_if(not ({_HEALTHY}))::bigint as not_positive_definite, 0::bigint as nan,
count_if({_HEALTHY})::bigint as finite, 0::bigint as missing, count(*) as pairs from gauss_bad s, (select unnest(['skl', 'js']) as kernel) k group by 1""")
def a9_failures(spark, sf):
    """Distances that round-off made negative count as finite: which ones, depends on the order of summation."""
    table = I.gauss_bad(spark, sf)
    found = failures(pair(table, query_points(table, [0], ["mean", "cov"])))
    return found.select("kernel", "not_positive_definite", "nan", (F.col("ok") + F.col("negative")).alias("finite"), "missing", "pairs")


@check("f5_mean_cut", _DIST + """select query_id, id, round(d_bh, 6) + 0.0 as d_bh from (select *, avg(d_bh) over (partition by query_id) as m from dist)
where d_bh < m""")
def f5_mean_cut(spark, sf):
    d = _distances(I.stored(spark, sf), I.query_list(spark, sf), ["bh"])
    joined = scaling.with_bounds(d, scaling.bounds(d, ["bh"], with_mean=True), few_queries=False)
    return rounded(plans.better_than_mean(joined, "bh").select(QUERY, "id", "d_bh"))


@check("f5_mean_cut_similarity", _DIST + """select query_id, id, round(d_chroma, 6) + 0.0 as d_chroma
from (select *, avg(d_chroma) over (partition by query_id) as m from dist) where d_chroma > m""")
def f5_mean_cut_similarity(spark, sf):
    d = _distances(I.stored(spark, sf), I.query_list(spark, sf), ["chroma"])
    joined = scaling.with_bounds(d, scaling.bounds(d, ["chroma"], with_mean=True), few_queries=False)
    return rounded(plans.better_than_mean(joined, "chroma").select(QUERY, "id", "d_chroma"))


@check("f6_candidates", _DIST + """select query_id, id, round(d_js, 6) + 0.0 as d_js from dist
qualify row_number() over (partition by query_id order by d_js, id) <= 25""")
def f6_candidates(spark, sf):
    d = plans.measured(I.stored(spark, sf), I.query_list(spark, sf), ["js"])[0]
    return rounded(ranking.nearest(d, 25, score="d_js").select(QUERY, "id", "d_js"))


@check("j3_distance_join", _DIST0 + f"select query_id, id, {_D} from dist")
def j3_distance_join(spark, sf):
    """The join form: one narrow table per distance."""
    tables = [plans.measured(I.stored(spark, sf), [0], [n])[0] for n in ALL]
    return rounded(plans.join_distances(tables).select(QUERY, "id", *[f"d_{n}" for n in ALL]))


@check("j5_distance_join_left", S.with_(S.VEC, S.GAUSS) + f"""select s.id, round({S.euclid('rp')}, 6) + 0.0 as d_rp,
round(g.d_skl, 6) + 0.0 as d_skl from vec s cross join vec q left join (select s.id, {S.SKL} as d_skl from gauss s, gauss q
where q.id = 0) g on g.id = s.id where q.id = 0""")
def j5_distance_join_left(spark, sf):
    rp = plans.measured(I.vec(spark, sf), [0], ["rp"])[0]
    skl = plans.measured(I.gauss(spark, sf), [0], ["skl"])[0]
    return rounded(plans.join_distances([rp, skl], "left").select("id", "d_rp", "d_skl"))


@check("j7_all_queries", _DIST + f"select query_id, id, {_D} from dist")
def j7_all_queries(spark, sf):
    return rounded(plans.measured(I.stored(spark, sf), I.query_list(spark, sf), ALL)[0])


@check("a1_statistics", _DIST + "select query_id, " + ", ".join(
    f"round({f}(d_{n}), 6) + 0.0 as {label}_{n}" for n in ALL
    for label, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("stddev", "stddev_samp"))
) + " from dist group by query_id")
def a1_statistics(spark, sf):
    d = plans.measured(I.stored(spark, sf), I.query_list(spark, sf), ALL)[0]
    return rounded(scaling.statistics(d, ALL))


def _scaled_sql(names):
    return _DIST.rstrip() + ", " + S.scaled_rows(names=names) + f" select query_id, id, {S.rounded(names, 'scaled_')} from scaled"


@check("a3_scaling", _scaled_sql(["rp", "rh", "bh", "notes", "js", "mfcc"]))
def a3_scaling(spark, sf):
    return rounded(_scaled(I.stored(spark, sf), I.query_list(spark, sf), ["rp", "rh", "bh", "notes", "js", "mfcc"]))


@check("a4_inverted_scaling", _scaled_sql(["chroma"]))
def a4_inverted_scaling(spark, sf):
    return rounded(_scaled(I.stored(spark, sf), I.query_list(spark, sf), ["chroma"]))


@check("a6_distinct", _DIST + f"select distinct query_id, id, {_D} from (select * from dist union all select * from dist)")
def a6_distinct(spark, sf):
    d = plans.measured(I.stored(spark, sf), I.query_list(spark, sf), ALL)[0]
    return rounded(feature_store.distinct_rows(d.unionByName(d)))


# --- scores and order --------------------------------------------------------------------------
def _score_sql(score: str, queries=S.QUERY_LIST) -> str:
    return S.with_(S.FEATURES, queries, S.distances(), S.scaled_rows()) + (
        f"select query_id, id, round({score}, 6) + 0.0 as aggregated from scaled")


def _score(spark, sf, score) -> DataFrame:
    return rounded(_result(spark, sf).select(QUERY, "id", score.alias("aggregated")))


@check("r1_mean_score", _score_sql(S.mean_score()))
def r1_mean_score(spark, sf):
    return _score(spark, sf, ranking.mean_score(ALL))


@check("r2_fast_score", _score_sql(S.mean_score(ranking.SUBSETS["fast"])))
def r2_fast_score(spark, sf):
    return _score(spark, sf, ranking.mean_score(ranking.SUBSETS["fast"]))


@check("r3_precise_score", _score_sql(S.mean_score(ranking.SUBSETS["precise"])))
def r3_precise_score(spark, sf):
    return _score(spark, sf, ranking.mean_score(ranking.SUBSETS["precise"]))


_OTHERS = ("notes_mfcc_rp", "notes_rh", "notes_rp_chroma_mfcc_skl_bh")


@check("r4_other_scores", S.RESULT + "select query_id, id, " + ", ".join(
    f"round({S.mean_score(ranking.SUBSETS[o])}, 6) + 0.0 as {o}" for o in _OTHERS) + " from scaled")
def r4_other_scores(spark, sf):
    return rounded(_result(spark, sf).select(
        QUERY, "id", *[ranking.mean_score(ranking.SUBSETS[o]).alias(o) for o in _OTHERS]))


_WEIGHTS = {"rp": 2.0, "notes": 1.0, "chroma": 0.5, "js": 1.5}


@check("r5_weighted_score", _score_sql("(" + " + ".join(f"{w}*scaled_{n}" for n, w in _WEIGHTS.items()) + f")/{sum(_WEIGHTS.values())}"))
def r5_weighted_score(spark, sf):
    return _score(spark, sf, ranking.weighted_score(_WEIGHTS))


def _search_columns(names=ALL) -> str:
    return f"query_id, id, {S.rounded(names, 'scaled_')}, round({S.mean_score(names)}, 6) + 0.0 as aggregated"


@check("r6_sorted", S.RESULT.replace(S.QUERY_LIST, S.QUERY_ZERO) + f"select id, round({S.mean_score()}, 6) + 0.0 as aggregated, row_number() over (order by round({S.mean_score()}, 9), id) as position from scaled")
def r6_sorted(spark, sf):
    """The position of every row in the order that the search gives."""
    ranked = plans.search(I.stored(spark, sf), [0]).select("id", "aggregated")
    # Written in order by as many tasks as there are ranges, so that the order of files and rows is the order of the result.
    at = ranked.withColumn("_at", F.monotonically_increasing_id()).withColumn(QUERY, F.lit(0))
    return rounded(running_total(at, [QUERY], ["_at"]).select("id", "aggregated", "position"))


@check("r7_top_k", S.RESULT.replace(S.QUERY_LIST, S.QUERY_ZERO) + f"select {_search_columns()} from scaled order by {S.mean_score()}, id limit 20")
def r7_top_k(spark, sf):
    return rounded(plans.search(I.stored(spark, sf), [0], k=20))


@check("r7_top_k_per_query", S.RESULT + f"""select {_search_columns()} from scaled
qualify row_number() over (partition by query_id order by {S.mean_score()}, id) <= 20""")
def r7_top_k_per_query(spark, sf):
    return rounded(plans.search(I.stored(spark, sf), I.query_list(spark, sf), k=20))


@check("r8_ranked_lists", _DIST + " union all ".join(
    f"""select query_id, '{n}' as feature, id, round(d_{n}, 6) + 0.0 as distance,
row_number() over (partition by query_id order by round(d_{n}, 9) {'desc' if n == 'chroma' else ''}, id) as position from dist"""
    for n in ALL))
def r8_ranked_lists(spark, sf):
    """All unscaled rankings in one pass: the distances become rows, chroma with its sign turned."""
    d = plans.measured(I.stored(spark, sf), I.query_list(spark, sf), ALL)[0]
    return rounded(ranking.ranked_lists(d, ALL))


# --- whole plans -------------------------------------------------------------------------------
@check("p1_full", S.RESULT.replace(S.QUERY_LIST, S.QUERY_ZERO) + f"select {_search_columns()} from scaled")
def p1_full(spark, sf):
    return rounded(plans.search(I.stored(spark, sf), [0]))


def _per_table_sql(queries: str, names=ALL) -> str:
    sources = {"rp": "vec", "rh": "vec", "bh": "vec", "notes": "notes", "chroma": "chroma", "skl": "gauss", "js": "gauss", "mfcc": "gauss"}
    forms = {**{n: S.euclid(n) for n in ("rp", "rh", "bh")}, "notes": S.LEVENSHTEIN, "skl": S.SKL, "js": S.JS, "mfcc": S.MFCC}
    ctes = [S.VEC, S.GAUSS, S.NOTES, S.CHROMA, queries]
    for n in names:
        pairs = f"from {sources[n]} s, {sources[n]} q where q.id in (select id from queries)"
        if n == "chroma":
            ctes.append(f"dist_chroma as (select query_id, id, {S.chroma_correlation('lags')} as d_chroma from (select q.id as query_id, s.id as id, {S.LAGS} as lags {pairs}))")
        else:
            ctes.append(f"dist_{n} as (select * from (select q.id as query_id, s.id as id, {forms[n]} as d_{n} {pairs}) {'where d_skl <= 10000' if n == 'skl' else ''})")
        ctes.append(f"scaled_{n} as (select query_id, id, {S.scaled(n)} as scaled_{n} from (select *, min(d_{n}) over w as min_{n}, max(d_{n}) over w as max_{n} from dist_{n} window w as (partition by query_id)))")
    joins = " ".join(f"join scaled_{n} using (query_id, id)" for n in names[1:])
    return S.with_(*ctes) + f"select {_search_columns(names)} from scaled_{names[0]} {joins}"


@check("p2_separate_tables", _per_table_sql(S.QUERY_ZERO))
def p2_separate_tables(spark, sf):
    return rounded(plans.search_tables(_tables(spark, sf), [0]))


@check("r2_fast_tables", _per_table_sql(S.QUERY_ZERO, list(ranking.SUBSETS["fast"])))
def r2_fast_tables(spark, sf):
    return rounded(plans.search_tables(_tables(spark, sf), [0], "fast"))


@check("r3_precise_tables", _per_table_sql(S.QUERY_ZERO, list(ranking.SUBSETS["precise"])))
def r3_precise_tables(spark, sf):
    return rounded(plans.search_tables(_tables(spark, sf), [0], "precise"))


@check("a5_scopes", "select coalesce(j.query_id, f.query_id) as query_id, id, j.aggregated as joined_scope, f.aggregated as feature_scope from ("
       + S.RESULT + f"select {_search_columns()} from scaled) j full join (" + _per_table_sql(S.QUERY_LIST) + ") f using (query_id, id)")
def a5_scopes(spark, sf):
    queries = I.query_list(spark, sf).join(I.stored(spark, sf), "id", "left_semi")
    joined = plans.search(I.stored(spark, sf), queries)
    feature = plans.search_tables(_tables(spark, sf), queries)
    return rounded(joined.select(QUERY, "id", F.col("aggregated").alias("joined_scope")).join(
        feature.select(QUERY, "id", F.col("aggregated").alias("feature_scope")), [QUERY, "id"], "full"))


def _refine_sql(stages, min_candidates: int = 0) -> str:
    ctes, source, done = [S.FEATURES, S.QUERY_LIST, S.distances()], "dist", []
    for i, n in enumerate(stages):
        better = f"d_{n} > mean" if n == "chroma" else f"d_{n} < mean"
        enough = f"count(*) filter ({better}) over (partition by query_id)" if min_candidates else "1"
        ctes.append(f"""bound_{i} as (select *, min(d_{n}) over w as min_{n}, max(d_{n}) over w as max_{n},
            avg(d_{n}) over w as mean from {source} {'where d_skl <= 10000' if n == 'skl' else ''} window w as (partition by query_id))""")
        ctes.append(f"""counted_{i} as (select *, {enough} as n_left from bound_{i})""")
        ctes.append(f"""stage_{i} as (select * exclude (mean, n_left, min_{n}, max_{n}), {S.scaled(n)} as scaled_{n} from counted_{i}
            where {better} {f'or n_left < {min_candidates}' if min_candidates else ''})""")
        source = f"stage_{i}"
        done.append(n)
    return S.with_(*ctes) + f"select {_search_columns(stages)} from {source}"


@check("p4_refine_chroma_first", _refine_sql(plans.CHROMA_FIRST))
def p4_refine_chroma_first(spark, sf):
    return rounded(plans.refine(I.stored(spark, sf), I.query_list(spark, sf), plans.CHROMA_FIRST))


@check("p4_refine_chroma_first_keep3", _refine_sql(plans.CHROMA_FIRST, 3))
def p4_refine_chroma_first_keep3(spark, sf):
    return rounded(plans.refine(I.stored(spark, sf), I.query_list(spark, sf), plans.CHROMA_FIRST, min_candidates=3))


@check("p5_refine_bh_first", _refine_sql(plans.BH_FIRST))
def p5_refine_bh_first(spark, sf):
    return rounded(plans.refine(I.stored(spark, sf), I.query_list(spark, sf), plans.BH_FIRST))


@check("p5_refine_bh_first_keep3", _refine_sql(plans.BH_FIRST, 3))
def p5_refine_bh_first_keep3(spark, sf):
    return rounded(plans.refine(I.stored(spark, sf), I.query_list(spark, sf), plans.BH_FIRST, min_candidates=3))


_OTHER7 = [n for n in ALL if n != "js"]


@check("p6_prefilter", S.with_(
    S.FEATURES, S.QUERY_ZERO, S.distances(),
    f"quick as (select *, {S.scaled('js')} as scaled_js from (select *, min(d_js) over (partition by query_id) as min_js, max(d_js) over (partition by query_id) as max_js from dist))",
    "best as (select * exclude (min_js, max_js) from quick qualify row_number() over (partition by query_id order by d_js, id) <= 25)",
    f"complete as (select *, {', '.join(f'min(d_{n}) over w as min_{n}, max(d_{n}) over w as max_{n}' for n in _OTHER7)} from best where d_skl <= 10000 window w as (partition by query_id))",
    f"scaled as (select query_id, id, scaled_js, {', '.join(f'{S.scaled(n)} as scaled_{n}' for n in _OTHER7)} from complete)",
) + f"select {_search_columns()} from scaled")
def p6_prefilter(spark, sf):
    return rounded(plans.prefilter(I.stored(spark, sf), [0]))


@check("p9_batch", S.RESULT + f"select {_search_columns()} from scaled")
def p9_batch(spark, sf):
    return rounded(plans.search(I.stored(spark, sf), I.query_list(spark, sf)))
