"""Round trips through feature files, results and class files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array

from checks import inputs as I
from checks import sql as S
from checks.frame import rounded
from checks.registry import Registry
from checks.searching import _DIST, _DIST0, ALL
from kindred.functions import ids
from kindred.operators.pairing import QUERY
from kindred.operators.scale_out import broadcast_if_small, scratch_path
from kindred.plans import search as plans
from kindred.sources import catalogue, feature_files as files, growing_store, tables

check = Registry()


def _path(id_="id", class_="class"):
    """A song path with every character that ids lose."""
    return F.concat(F.lit("music/"), F.col(class_), F.lit("/Song no. "), F.col(id_), F.lit(", live.mp3"))


_ID = "'music/' || class || '/Songno' || id || 'livemp3' as id"


def _joined(array) -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def _written(spark, lines: DataFrame, file: str) -> str:
    """Write lines into two feature folders; returns the glob that finds both."""
    root = scratch_path(spark, "files")
    halves = lines.withColumn("_folder", F.concat(F.lit("features"), F.col("_half").cast("string")))
    for half in (0, 1):
        halves.filter(F.col("_half") == half).select("value").write.text(f"{root}/features{half}/{file}")
    return f"{root}/features[0-9]*/out[0-9]*.{file.split('.')[1]}"


def _half():
    return (F.col("class") >= 5).cast("int").alias("_half")


def _vector_lines(spark, sf, name: str, wrap: bool = False) -> DataFrame:
    quote = (lambda c: F.concat(F.lit("b'"), c, F.lit("'"))) if wrap else (lambda c: c)
    path = F.translate(_path(), ",", "")
    values = F.array_join(F.transform(name, lambda x: quote(x.cast("string"))), ",")
    return I.vec(spark, sf).select(_half(), F.concat_ws(",", quote(path), values).alias("value"))


@check("s1_scan", S.with_(S.VEC) + "select count(*) as lines, 32::bigint as partitions from vec")
def s1_scan(spark, sf):
    lines = files.read_lines(spark, _written(spark, _vector_lines(spark, sf, "rh"), "out0.rh"), min_partitions=32)
    return lines.agg(F.count("*").alias("lines")).withColumn("partitions", F.lit(lines.rdd.getNumPartitions()).cast("long"))


_VECTOR = f"{_ID}, len(rh) as n, round(rh[1], 6) + 0.0 as first, round(list_sum(rh), 6) + 0.0 as total"


def _vector(df: DataFrame, name: str) -> DataFrame:
    total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("id", F.size(name).cast("long").alias("n"), F.element_at(name, 1).alias("first"), total.alias("total")))


@check("s2_vectors", S.with_(S.VEC) + f"select {_VECTOR} from vec")
def s2_vectors(spark, sf):
    pattern = _written(spark, _vector_lines(spark, sf, "rh"), "out0.rh")
    return _vector(files.parse_vectors(files.read_lines(spark, pattern), "rh"), "rh")


@check("s9_byte_literals", S.with_(S.VEC) + f"select {_VECTOR} from vec")
def s9_byte_literals(spark, sf):
    pattern = _written(spark, _vector_lines(spark, sf, "rh", wrap=True), "out0.rh")
    return _vector(files.parse_vectors(files.read_lines(spark, pattern), "rh"), "rh")


@check("s3_beats", S.with_(S.VEC) + f"select {_ID}, 60 + id / 4.0::double as bpm, len(bh) as n, round(list_sum(bh), 6) + 0.0 as total from vec")
def s3_beats(spark, sf):
    lines = I.vec(spark, sf).select(_half(), F.concat_ws("; ", _path(), (60 + F.col("id") / 4).cast("string"),
                                                         F.concat(F.lit("["), _joined("bh"), F.lit("]"))).alias("value"))
    rows = files.parse_beats(files.read_lines(spark, _written(spark, lines, "out0.bh")))
    return rounded(rows.select("id", "bpm", F.size("bh").cast("long").alias("n"),
                               F.aggregate("bh", F.lit(0.0), lambda a, x: a + x).alias("total")))


@check("s4_records", S.with_(S.GAUSS) + f"""select {_ID.replace("class", "'7'")}, round(m1, 6) + 0.0 as m1, round(m2, 6) + 0.0 as m2,
round(c11, 6) + 0.0 as c11, round(c12, 6) + 0.0 as c12, round(c22, 6) + 0.0 as c22 from gauss""")
def s4_records(spark, sf):
    """Two values of mean and a 2 x 2 covariance after an id that ends at its extension."""
    text = F.format_string("[%s ,  %s]; [[%s, %s], [%s ,%s]]", *[F.col("mean")[i].cast("string") for i in (0, 1)],
                           *[F.col("cov")[i].cast("string") for i in range(4)])
    lines = I.gauss(spark, sf).withColumn("class", F.lit(7)).select(
        _half(), F.concat_ws("; ", F.translate(_path(), ";", ""), text).alias("value"))
    rows = files.parse_gaussians(files.read_lines(spark, _written(spark, lines, "out0.mfcckl")))
    return rounded(rows.select("id", *[F.col("mean")[i].alias(f"m{i + 1}") for i in (0, 1)],
                               *[F.col("cov")[i].alias(n) for i, n in ((0, "c11"), (2, "c12"), (3, "c22"))]))


@check("s5_notes", S.with_(S.NOTES) + "select 'music/Songno' || id || 'livemp3' as id, 'G#' as key, 'minor' as scale, translate(notes, 'ABCDE', 'AKLBC') as notes from notes")
def s5_notes(spark, sf):
    ints = F.transform(F.split("notes", ""), lambda c: F.element_at(
        F.create_map(*[F.lit(x) for kv in {"A": "0", "B": "10", "C": "11", "D": "1", "E": "2"}.items() for x in kv]), c))
    path = F.concat(F.lit("music/Song no. "), F.col("id"), F.lit(", live.mp3"))
    lines = I.notes(spark, sf).withColumn("class", F.lit(0)).select(
        _half(), F.concat_ws("; ", path, F.lit("G#"), F.lit("minor"),
                             F.concat(F.lit("["), F.array_join(ints, ", "), F.lit("]"))).alias("value"))
    return files.parse_notes(files.read_lines(spark, _written(spark, lines, "out0.notes")))


@check("s6_ids", """select page_id, translate(url, ';., ', '') as id, translate(url, ';., []', '') as bracketless,
translate(source, ';., ', '') as source from pages left join documents on doc_id = page_id""")
def s6_ids(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "source")
    return I.table(spark, sf, "pages").select("page_id", "url").join(docs, "page_id", "left").select(
        "page_id", ids.normalise(F.col("url")).alias("id"), ids.normalise(F.col("url"), brackets=True).alias("bracketless"),
        ids.normalise(F.col("source")).alias("source"))


def _chroma_lines(spark, sf) -> DataFrame:
    rows = F.array_join(F.transform("chroma", lambda x: F.format_string("%.6f", x)), ", ")
    body = F.when(F.col("class") == 9, F.lit("[]")).otherwise(F.concat(F.lit("[["), rows, F.lit("]]")))
    classes = I.vec(spark, sf).select("id", "class")
    return I.chroma(spark, sf).join(classes, "id").select(_half(), F.concat_ws("; ", _path(), body).alias("value"))


_USABLE = "class <> 9 and (printf('%.6f', chroma[1]) like '0.%' or printf('%.6f', chroma[1]) like '1.%')"
_CHROMA = S.with_(S.VEC, S.CHROMA)


@check("s7_malformed", _CHROMA + f"""select {_ID}, coalesce({_USABLE}, false) as accepted,
case when {_USABLE} then 72 else 0 end::bigint as n from chroma join vec using (id)""")
def s7_malformed(spark, sf):
    good, rejected = files.parse_chroma(files.read_lines(spark, _written(spark, _chroma_lines(spark, sf), "out0.chroma")))
    return good.select("id", F.lit(True).alias("accepted"), F.size("chroma").cast("long").alias("n")).unionByName(
        rejected.select("id", F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("n")))


_BAD_NOTES = "case id % 4 when 0 then '[1, 12]' when 1 then '[x, 3]' when 2 then '[-1]' else '[1.5]' end"


_LINE = "'music/' || class || '/Song no. ' || id || ', live.mp3'"


@check("s7_rejects", S.with_(S.VEC) + f"""select 'notes' as file_type, {_ID}, 'bad values' as reason, {_LINE} || '; G; minor; ' || {_BAD_NOTES} as line from vec where id % 3 = 0
union all select 'chroma', {_ID}, 'bad values', {_LINE} || case when id % 2 = 0 then '; [[0.5, 0.5]]' else '; []' end from vec where id % 5 = 0
union all select 'rp', {_ID}, 'bad values', replace({_LINE}, ',', '') || ',0.1,oops' from vec where id % 7 = 0
union all select 'bh', '', 'no id', '; 120; [1, 2]' from vec where id % 11 = 0""")
def s7_rejects(spark, sf):
    """Bad lines among good ones, in every kind of file that is checked in its own way."""
    vec, root = I.vec(spark, sf), scratch_path(spark, "rejects")
    path, name = _path(), F.translate(_path(), ",", "")
    good = F.lit("[[" + ", ".join(["0.5"] * 24) + "]]")
    files_of = {
        "notes": F.concat_ws("; ", path, F.lit("G"), F.lit("minor"), F.when(F.col("id") % 3 == 0, F.expr(_BAD_NOTES)).otherwise(F.lit("[0, 11]"))),
        "chroma": F.concat_ws("; ", path, F.when(F.col("id") % 5 != 0, good).when(F.col("id") % 2 == 0, F.lit("[[0.5, 0.5]]")).otherwise(F.lit("[]"))),
        "rp": F.concat(name, F.when(F.col("id") % 7 == 0, F.lit(",0.1,oops")).otherwise(F.lit(",0.1,0.2"))),
        "rh": F.concat(name, F.lit(",1")),
        "bh": F.concat(F.when(F.col("id") % 11 == 0, F.lit("")).otherwise(path), F.lit("; 120; [1, 2]")),
        "mfcckl": F.concat(path, F.lit("; [1]; [[2]]")),
    }
    for kind, line in files_of.items():
        vec.select(line.alias("value")).write.text(f"{root}/features0/out0.{kind}")
    return files.load_rejects(spark, root).select("file_type", "id", "reason", "line")


@check("j8_incremental", S.with_(S.VEC) + f"""select {_ID}, case when id % 3 = 0 then 1 else 2 end as version, (120 + id)::double as bpm,
printf('%.6f', rp[40])::double as last, (select count(*) from vec) as items, true as only_once from vec""")
def j8_incremental(spark, sf):
    """Files come in two lots, the chroma of every third item with the second; the third build finds nothing new, whole and half copies change nothing."""
    vec, root = I.vec(spark, sf), scratch_path(spark, "growing")
    path, name, store = _path(), F.translate(_path(), ",", ""), scratch_path(spark, "grown")
    values = lambda x: F.array_join(F.transform(x, lambda v: F.format_string("%.6f", v)), ", ")
    lines = {
        "rp": F.concat(name, F.lit(","), values("rp")), "rh": F.concat(name, F.lit(","), values("rh")),
        "bh": F.concat(path, F.lit("; "), (F.col("id") + 120).cast("string"), F.lit("; ["), values("bh"), F.lit("]")),
        "notes": F.concat(path, F.lit("; G; minor; [0, 11]")), "mfcckl": F.concat(path, F.lit("; [1]; [[2]]")),
        "chroma": F.concat(path, F.lit("; [["), F.array_join(F.array_repeat(F.lit("0.5"), 24), ", "), F.lit("]]")),
    }
    first, late = vec.filter("id % 3 < 2"), vec.filter("id % 3 = 2")
    for kind, line in lines.items():
        (first if kind != "chroma" else vec.filter("id % 3 = 0")).select(line.alias("value")).write.text(f"{root}/features0/out0.{kind}")
    growing_store.extend(spark, root, store)
    for kind, line in lines.items():
        lot = late if kind != "chroma" else vec.filter("id % 3 > 0")
        lot.unionByName(vec.filter("id % 6 = 0")).select(line.alias("value")).write.text(f"{root}/features1/out0.{kind}")
    growing_store.extend(spark, root, store)
    found = growing_store.extend(spark, root, store)
    return found.rows.select(
        "id", "version", "bpm", F.element_at("rp", 40).alias("last"), F.lit(found.items).alias("items"), F.lit(found.unique).alias("only_once"),
    )


@check("s8_vectors", S.with_(S.VEC) + "select id, len(rp) as n, round(rp[40], 6) + 0.0 as last from vec")
def s8_vectors(spark, sf):
    values = vector_to_array(array_to_vector("rp"))
    return rounded(I.vec(spark, sf).select("id", F.size(values).cast("long").alias("n"), F.element_at(values, -1).alias("last")))


_PREFIXES = ("https://www.", "http://www.", "https://", "http://")


@check("s10_prefixes", r"select page_id, regexp_replace(url, 'https?://(www\.)?', '', 'g') as path from pages")
def s10_prefixes(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", ids.strip_prefixes(F.col("url"), _PREFIXES).alias("path"))


@check("s11_corrections", """select c_custkey, case when n_nationkey < 5 then r_name else n_name end as id
from customer join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_nationkey""")
def s11_corrections(spark, sf):
    nation, region = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    wrong = nation.join(region, nation.n_nationkey == region.r_regionkey).select(F.col("n_name").alias("wrong"), F.col("r_name").alias("right"))
    customers = I.table(spark, sf, "customer").join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalogue.correct_ids(customers.select("c_custkey", F.col("n_name").alias("id")), wrong)


@check("s12_compaction", S.with_(S.VEC) + f"select {_VECTOR} from vec")
def s12_compaction(spark, sf):
    root = scratch_path(spark, "compact")
    small = _written(spark, _vector_lines(spark, sf, "rh").repartition(16), "out0.rh")
    tables.compact(spark, small, f"{root}/merged.rh", file_bytes=32 << 10)
    return _vector(files.parse_vectors(files.read_lines(spark, f"{root}/merged.rh"), "rh"), "rh")


@check("s13_header_csv", S.with_(S.VEC) + "select id::varchar as id, len(rh) as n, round(rh[1], 6) + 0.0 as first, round(list_sum(rh), 6) + 0.0 as total from vec")
def s13_header_csv(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_header_csv(I.vec(spark, sf), "rh", path)
    return _vector(tables.read_header_csv(spark, path, "rh"), "rh")


@check("s14_inventory", """select url as path, (row_number() over (order by url) - 1) // ((select count(*) from pages) // ((select count(*) from pages) // 25 + 1) + 1) as shard
from pages""")
def s14_inventory(spark, sf):
    return catalogue.inventory(I.table(spark, sf, "pages").select(F.col("url").alias("path")))


@check("s15_query_list", S.with_(S.VEC) + f"select {_ID} from vec")
def s15_query_list(spark, sf):
    root = scratch_path(spark, "list")
    shards = I.vec(spark, sf).select(_path().alias("path"), F.lit(0).alias("shard"))
    catalogue.file_list_lines(shards).write.text(root)
    return files.parse_query_list(files.read_lines(spark, root))


_DCOLS = [f"d_{n}" for n in ALL]
_RESULT_SQL = f"select query_id, id, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in _DCOLS)} from dist"
_SCHEMA = "id bigint, " + ", ".join(f"{c} double" for c in _DCOLS)


def _saved(spark, sf, queries, by_query: bool, form: str = "csv") -> tuple[str, DataFrame]:
    path = scratch_path(spark, "results")
    d = plans.measured(I.stored(spark, sf), queries, ALL)[0].select(QUERY, "id", *_DCOLS)
    tables.write_results(d if by_query else d.drop(QUERY), path, form=form, by_query=by_query)
    return path, d


@check("s16_result_scan", _DIST0 + _RESULT_SQL.replace("query_id, ", ""))
def s16_result_scan(spark, sf):
    path, _ = _saved(spark, sf, [0], by_query=False)
    return rounded(tables.read_results(spark, path, _SCHEMA))


@check("s17_result_sink", _DIST + _RESULT_SQL)
def s17_result_sink(spark, sf):
    path, d = _saved(spark, sf, I.query_list(spark, sf), by_query=True, form="parquet")
    return rounded(tables.read_results(spark, path, d.schema, form="parquet"))


@check("s18_result_union", _DIST + _RESULT_SQL)
def s18_result_union(spark, sf):
    """All per-query files in one read; the query is part of the path."""
    path, _ = _saved(spark, sf, I.query_list(spark, sf), by_query=True)
    rows = tables.read_results(spark, f"{path}/query_id=*/*.csv", _SCHEMA)
    query = F.regexp_extract(F.input_file_name(), r"query_id=(\d+)", 1).cast("long")
    return rounded(rows.withColumn(QUERY, query))


def _long(vec: DataFrame) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("values")) for n in ("rp", "rh", "bh")]))
    return vec.select("id", F.col("class").cast("string").alias("id2"), both.alias("f")).select("f.feature", "id", "id2", "f.values")


_LONG = "id, class::varchar as id2, len(rh) as n, round(list_sum(rh), 6) + 0.0 as total"


def _long_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("id", "id2", F.size("values").cast("long").alias("n"),
                             F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


@check("s19_append", S.with_(S.VEC) + f"select {_LONG} from vec")
def s19_append(spark, sf):
    path = scratch_path(spark, "features")
    vec = I.vec(spark, sf)
    tables.write_features(_long(vec.filter("class < 5")), path)
    tables.write_features(_long(vec.filter("class >= 5")), path)
    return _long_out(tables.read_features(spark, [path], "rh"))


@check("s20_feature_sets", S.with_(S.VEC) + f"select {_LONG} from vec")
def s20_feature_sets(spark, sf):
    paths = [scratch_path(spark, "features") for _ in range(2)]
    for path, part in zip(paths, ("class < 5", "class >= 5")):
        tables.write_features(_long(I.vec(spark, sf).filter(part)), path)
    return _long_out(tables.read_features(spark, paths, "rh"))


@check("s21_class_file", "select doc_id::varchar as id, quality::varchar as class from labels")
def s21_class_file(spark, sf):
    path = scratch_path(spark, "classes")
    tables.write_classes(I.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("class")), path)
    return tables.read_classes(spark, path)


@check("s22_label_table", "select doc_id::varchar as id, quality, toxic from labels")
def s22_label_table(spark, sf):
    path = scratch_path(spark, "labels")
    tables.write_label_table(I.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), ["quality", "toxic"], path)
    return tables.read_label_table(spark, path, ["quality", "toxic"])


@check("s23_first_n", S.with_(S.FEATURES) + "select id, class, length(notes) as n_notes from store order by id limit 50")
def s23_first_n(spark, sf):
    return catalogue.first_n(I.stored(spark, sf), 50).select("id", "class", F.length("notes").cast("long").alias("n_notes"))
