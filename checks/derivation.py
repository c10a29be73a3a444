"""Frame-level tables to track-level features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.frame import rounded
from checks.registry import Registry
from kindred.operators import derive as D

check = Registry()

_KEYS = ("A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "Ab", "Gb", "Eb", "Db", "Bb")
_SHIFT = "[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11, 9, 6, 4, 1]"


def _key(id_):
    """Every item gets one of the 17 spellings in turn."""
    return F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col(id_) % len(_KEYS) + 1).cast("int"))


@check("t1_common_key", S.with_(S.CHROMA) + f"""select id, (i // 6 + 12 - {_SHIFT}[(id % 17 + 1)::int]) % 12 as line, i % 6 as beat,
round(value, 6) + 0.0 as value from (select id, unnest(range(72)) as i, unnest(chroma) as value from chroma)""")
def t1_common_key(spark, sf):
    cells = I.chroma(spark, sf).select("id", _key("id").alias("key"), F.posexplode("chroma").alias("i", "value"))
    line = D.to_common_key(F.floor(F.col("i") / 6), F.col("key"))
    return rounded(cells.select("id", line.alias("line"), (F.col("i") % 6).cast("long").alias("beat"), "value"))


@check("t2_transpose", S.with_(S.NOTES) + f"""select id, array_to_string(list_transform(string_split(notes, ''),
lambda c: (ascii(c) - 65 + 12 - {_SHIFT}[(id % 17 + 1)::int]) % 12), ',') as notes from notes""")
def t2_transpose(spark, sf):
    numbers = F.transform(F.split("notes", ""), lambda c: F.ascii(c) - 65)
    rows = I.notes(spark, sf).select("id", _key("id").alias("key"), numbers.alias("notes"))
    moved = D.transpose_notes(F.col("notes"), F.col("key"))
    return rows.select("id", F.array_join(F.transform(moved, lambda n: n.cast("string")), ",").alias("notes"))


_FRAMES = """frames as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) as frame,
    case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bin,
    coalesce(value, 0) as value, event_type = 'signup' as is_beat from events),
placed as (select *, count_if(is_beat) over (partition by track order by frame)::bigint as interval,
    count_if(is_beat) over (partition by track)::bigint as beats from frames),
sizes as (select track, interval, count(*) as n from placed where interval < beats group by all),
means as (select s.track, s.interval, b.bin, coalesce(sum(p.value), 0) / any_value(s.n) as mean
    from sizes s cross join (select unnest(range(5)) as bin) b left join placed p
    on p.track = s.track and p.interval = s.interval and p.bin = b.bin group by all)"""


def _intervals(spark, sf):
    frames = I.frames(spark, sf)
    values = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda b: F.when(b == F.col("bin"), F.col("value")).otherwise(0.0))
    return D.with_intervals(frames.withColumn("values", values).drop("bin", "value"), ["ts", "event_id"])


@check("t3_beat_averages", S.with_(_FRAMES) + """select track, interval, bin,
round(coalesce(mean / nullif(sum(abs(mean)) over (partition by track, interval), 0), 0), 9) + 0.0 as value from means""")
def t3_beat_averages(spark, sf):
    out = D.beat_averages(_intervals(spark, sf), 5).select("track", "interval", F.posexplode("values").alias("bin", "value"))
    return rounded(out.withColumn("bin", F.col("bin").cast("long")), 9)


_LOUD = "loud as (select track, sum(value) / count(*) / 2 as silence from frames group by track)"


@check("t4_dominant_bins", S.with_(_FRAMES, _LOUD, """peaks as (select track, interval, bin, sum(case when value > silence then
    1.0 else 0.0 end) as n from placed join loud using (track) where interval < beats group by all)""") + """
select track, interval, case when max(n) = 0 then 0 else arg_max(bin, (n, -bin)) end::int as note from peaks group by all""")
def t4_dominant_bins(spark, sf):
    return D.dominant_bins(_intervals(spark, sf), 5)


@check("t4_dominant_bins_averaged", S.with_(_FRAMES, _LOUD, """tops as (select *, max(mean) over (partition by track, interval) as top,
    sum(mean) over (partition by track, interval) as total from means),
peaks as (select track, interval, bin, case when total <= silence then 0.0 when mean = top then 1.0 when mean < 0.8 then 0.0
    else mean end as peak from tops join loud using (track))""") + """
select track, interval, arg_max(bin, (peak, -bin))::int as note from peaks group by all""")
def t4_dominant_bins_averaged(spark, sf):
    return D.dominant_bins(_intervals(spark, sf), 5, averaged=True)


_COLUMNS = ("l_quantity", "l_discount", "l_tax")


@check("t5_gaussian_summary", "select l_suppkey as id, " + ", ".join(
    [f"round(avg({c}), 6) + 0.0 as mean_{i}, round(var_pop({c}), 6) + 0.0 as var_{i}" for i, c in enumerate(_COLUMNS)]
    + [f"round(covar_samp({a}, {b}), 6) + 0.0 as cov_{n}" for n, (a, b) in enumerate(
        (_COLUMNS[i], _COLUMNS[j]) for i in range(3) for j in range(i, 3))]) + " from lineitem group by l_suppkey")
def t5_gaussian_summary(spark, sf):
    rows = I.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "id")
    out = D.gaussian_summary(rows, ["id"], _COLUMNS)
    return rounded(out.select("id", *[F.col(a)[i].alias(f"{a}_{i}") for a, n in (("mean", 3), ("var", 3), ("cov", 6)) for i in range(n)]))


def _seven(source: str, by: str, x: str, digits: int = 6) -> str:
    m = f"avg({x})"
    central = f"(select *, {x} - avg({x}) over (partition by {by}) as dev from {source})"
    return f"""select {by}, round({m}, {digits}) + 0.0 as mean, round(var_pop({x}), {digits}) + 0.0 as var,
round(coalesce(avg(dev*dev*dev) / nullif(pow(avg(dev*dev), 1.5), 0), 0), {digits}) + 0.0 as skew,
round(coalesce(avg(dev*dev*dev*dev) / nullif(pow(avg(dev*dev), 2), 0), 0), {digits}) + 0.0 as kurtosis,
round(median({x}), {digits}) + 0.0 as median, round(min({x}), {digits}) + 0.0 as min, round(max({x}), {digits}) + 0.0 as max from {central} group by {by}"""


@check("t6_seven_statistics", _seven("lineitem", "l_suppkey", "l_extendedprice", 3))
def t6_seven_statistics(spark, sf):
    return rounded(D.seven_statistics(I.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice"), 3)


_LONG = S.VEC + ", long as (select class, unnest(rp) as value, unnest(range(40)) as pos from vec)"


@check("t7_segment_medians", S.with_(_LONG) + """select class, pos, round(median(value), 6) + 0.0 as value, round(avg(value), 6) + 0.0 as mean
from long group by all""")
def t7_segment_medians(spark, sf):
    vec = I.vec(spark, sf)
    median = D.segments_to_track(vec, ["class"], "rp")
    mean = D.segments_to_track(vec, ["class"], "rp", "mean").withColumnRenamed("value", "mean")
    return rounded(median.join(mean, ["class", "pos"]).withColumn("pos", F.col("pos").cast("long")))


@check("t8_temporal_statistics", S.with_(_LONG) + _seven("long", "class, pos", "value"))
def t8_temporal_statistics(spark, sf):
    return rounded(D.temporal_statistics(I.vec(spark, sf), ["class"], "rp").withColumn("pos", F.col("pos").cast("long")))


@check("t9_rhythm_histogram", S.with_(S.VEC) + """select id, i // 4 as bin, round(sum(abs(x)), 6) + 0.0 as value
from (select id, unnest(rp) as x, unnest(range(40)) as i from vec) group by all""")
def t9_rhythm_histogram(spark, sf):
    sums = I.vec(spark, sf).select("id", F.posexplode(D.rhythm_histogram(F.col("rp"), 4, 10)).alias("bin", "value"))
    return rounded(sums.withColumn("bin", F.col("bin").cast("long")))


_EDGES = (0.0, 5.0, 12.0, 20.0, 31.0, 44.0)


@check("t10_band_sums", """select l_suppkey, band, round(sum(l_extendedprice), 2) + 0.0 as total from lineitem
join (select unnest(range(5)) as band, unnest([0.0, 5.0, 12.0, 20.0, 31.0]) as low, unnest([5.0, 12.0, 20.0, 31.0, 44.0]) as high)
on l_quantity >= low and l_quantity < high group by all""")
def t10_band_sums(spark, sf):
    out = D.band_sums(I.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", _EDGES)
    return rounded(out.withColumn("band", F.col("band").cast("long")), 2)
