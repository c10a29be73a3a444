"""SQL definitions shared by the expected answers (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

NAMES = ("rp", "rh", "bh", "notes", "chroma", "skl", "js", "mfcc")

VEC = """vec as (select vec_id as id, embedding[1:40]::double[] as rp, embedding[41:52]::double[] as rh,
    embedding[53:64]::double[] as bh, label as class from embeddings)"""

GAUSS = """gauss as (select l_suppkey as id, avg(l_quantity) as m1, avg(l_discount) as m2,
    var_samp(l_quantity) as c11, covar_samp(l_quantity, l_discount) as c12, var_samp(l_discount) as c22
    from lineitem group by l_suppkey)"""

GAUSS_BAD = """gauss_bad as (select id * 4 + form as id, m1, m2,
    case form when 0 then c11 when 1 then 0 when 2 then 1 else -c11 end as c11,
    case form when 0 then c12 when 1 then 0 when 2 then 1 else -c12 end as c12,
    case form when 0 then c22 when 1 then 0 when 2 then 1 else -c22 end as c22
    from gauss, (select unnest(range(4)) as form))"""

NOTES = """notes as (select user_id as id, string_agg(case event_type when 'click' then 'A' when 'error' then 'B'
    when 'purchase' then 'C' when 'signup' then 'D' else 'E' end, '' order by ts, event_id) as notes
    from events group by user_id)"""

# ct is the chroma matrix read beat by beat, so that a time shift is a shift of 12 entries
CHROMA = """chroma as (select id, chroma, list_transform(range(72), lambda i: chroma[((i % 12) * 6 + i // 12 + 1)::int]) as ct
    from (select vec_id as id, list_concat(embedding::double[], list_transform(range(8), lambda i: 0.0::double)) as chroma from embeddings))"""

STORE = "store as (select * from vec join gauss using (id) join notes using (id) join chroma using (id))"

QUERY_LIST = "queries as (select n_nationkey::bigint as id from nation)"
QUERY_ZERO = "queries as (select 0::bigint as id)"

FEATURES = ",\n".join([VEC, GAUSS, NOTES, CHROMA, STORE])


def euclid(name: str) -> str:
    return f"list_distance(s.{name}, q.{name})"


MFCC = """sqrt((s.m1-q.m1)*(s.m1-q.m1) + (s.m2-q.m2)*(s.m2-q.m2) + (s.c11-q.c11)*(s.c11-q.c11)
    + (s.c12-q.c12)*(s.c12-q.c12) + (s.c22-q.c22)*(s.c22-q.c22))"""

_DET_S, _DET_Q = "(s.c11*s.c22-s.c12*s.c12)", "(q.c11*q.c22-q.c12*q.c12)"

SKL = f"""greatest(0.25*((s.c11*q.c22 - 2*s.c12*q.c12 + s.c22*q.c11)/{_DET_Q}
    + (q.c11*s.c22 - 2*q.c12*s.c12 + q.c22*s.c11)/{_DET_S}
    + (s.m1-q.m1)*(s.m1-q.m1)*(s.c22/{_DET_S} + q.c22/{_DET_Q})
    - 2*(s.m1-q.m1)*(s.m2-q.m2)*(s.c12/{_DET_S} + q.c12/{_DET_Q})
    + (s.m2-q.m2)*(s.m2-q.m2)*(s.c11/{_DET_S} + q.c11/{_DET_Q}) - 4), 0)"""


def _mixed(a: str, b: str, c: str) -> str:
    return (f"(0.5*(s.{c}+s.{a}*s.{b}) + 0.5*(q.{c}+q.{a}*q.{b})"
            f" - (0.5*s.{a}+0.5*q.{a})*(0.5*s.{b}+0.5*q.{b}))")


JS = f"""greatest(0.5*ln({_mixed('m1', 'm1', 'c11')}*{_mixed('m2', 'm2', 'c22')}
    - {_mixed('m1', 'm2', 'c12')}*{_mixed('m1', 'm2', 'c12')}) - 0.25*ln({_DET_S}) - 0.25*ln({_DET_Q}), 0)"""

LEVENSHTEIN = "levenshtein(s.notes, q.notes)::double"

# six time lags of two 12 x 6 matrices, the query being the fixed one
_LAGS = ("q.ct[1:36], s.ct[37:72]", "q.ct[1:48], s.ct[25:72]", "q.ct[1:60], s.ct[13:72]", "q.ct, s.ct",
         "q.ct[13:72], s.ct[1:60]", "q.ct[25:72], s.ct[1:48]")
LAGS = "[" + ", ".join(f"list_dot_product({lag})" for lag in _LAGS) + "]"


def chroma_correlation(lags: str) -> str:
    """High-pass of the six lags without their offset, then the maximum."""
    y, terms = "0.0", ["0.0"]
    for j in range(2, 7):
        y = f"(0.7265425280*{y} + 0.8632712640*({lags}[{j}]-{lags}[{j - 1}]))"
        terms.append(y)
    return f"greatest({', '.join(terms)})"


def distances(source: str = "store") -> str:
    """CTE ``dist``: all eight distances of every row of ``source`` to every row of ``queries``."""
    return f"""dist as (select query_id, id, d_rp, d_rh, d_bh, d_notes, {chroma_correlation('lags')} as d_chroma,
    d_skl, d_js, d_mfcc from (select q.id as query_id, s.id as id, {euclid('rp')} as d_rp, {euclid('rh')} as d_rh,
    {euclid('bh')} as d_bh, {LEVENSHTEIN} as d_notes, {LAGS} as lags, {SKL} as d_skl, {JS} as d_js, {MFCC} as d_mfcc
    from {source} s, {source} q where q.id in (select id from queries)))"""


def scaled(name: str) -> str:
    unit = f"(d_{name}-min_{name})/nullif(max_{name}-min_{name}, 0)"
    return f"1-{unit}" if name == "chroma" else unit


def scaled_rows(source: str = "dist", names: Sequence[str] = NAMES, out: str = "scaled") -> str:
    """CTEs ``complete`` and ``out``: filters, bounds over what is left, scaled distances."""
    keep = "where d_skl <= 10000" if "skl" in names else ""
    bounds = ", ".join(f"min(d_{n}) over w as min_{n}, max(d_{n}) over w as max_{n}" for n in names)
    return f"""complete as (select *, {bounds} from {source} {keep} window w as (partition by query_id)),
{out} as (select query_id, id, {', '.join(f'{scaled(n)} as scaled_{n}' for n in names)} from complete)"""


def mean_score(names: Sequence[str] = NAMES) -> str:
    return "(" + " + ".join(f"scaled_{n}" for n in names) + f")/{len(names)}"


def rounded(names: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 6) + 0.0 as {prefix}{n}" for n in names)


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


RESULT = with_(FEATURES, QUERY_LIST, distances(), scaled_rows())
