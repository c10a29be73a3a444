"""Plans on a small store: invariants, strategies and scopes."""

import re
from dataclasses import replace
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import inputs, searching
from kindred.operators import lsh, measures, pairing, ranking, scaling
from kindred.operators.measures import MEASURES, is_comparable
from kindred.operators.scale_out import materialise
from kindred.operators.store import Catalogue, distinct_rows, duplicate_ids, gather, id_consistency, write_store
from kindred.plans import search as plans

ALL = ranking.SUBSETS["all"]
N = 60


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    vec, gauss, notes, chroma = [], [], [], []
    for i in range(N):
        m = rng.normal(size=(3, 3))
        vec.append((i, rng.random(6).tolist(), rng.random(4).tolist(), rng.random(5).tolist(), float(100 + i)))
        gauss.append((i, rng.normal(size=3).tolist(), (m @ m.T + np.eye(3)).ravel().tolist()))
        notes.append((i, "C", "major", "".join(rng.choice(list("ABCDEFG"), 12))))
        chroma.append((i, rng.random(12 * (4 + i % 3)).tolist()))
    frames = {
        "vec": spark.createDataFrame(vec, "id long, rp array<double>, rh array<double>, bh array<double>, bpm double"),
        "gauss": spark.createDataFrame(gauss, "id long, mean array<double>, cov array<double>"),
        "notes": spark.createDataFrame(notes, "id long, key string, scale string, notes string"),
        "chroma": spark.createDataFrame(chroma, "id long, chroma array<double>"),
    }
    return {k: v.cache() for k, v in frames.items()}


@pytest.fixture(scope="module")
def store(tables):
    return gather(list(tables.values())).cache()


def served(tables):
    return [(tables["vec"], ["rp", "rh", "bh"]), (tables["gauss"], ["mfcc", "skl", "js"]), (tables["notes"], ["notes"]),
            (tables["chroma"], ["chroma"])]


def rows(df):
    return {(r.query_id, r.id): r.asDict() for r in df.collect()}


def test_every_item_is_ranked_and_scaled(store):
    got = plans.search(store, [3]).collect()
    assert len(got) == N and [r.aggregated for r in got] == sorted(r.aggregated for r in got)
    for r in got:
        assert all(0 <= r[f"scaled_{n}"] <= 1 for n in ALL)
    own = next(r for r in got if r.id == 3)
    assert all(own[f"scaled_{n}"] == 0 for n in ALL if n != "chroma")
    assert {"key", "scale", "bpm"} <= set(got[0].asDict())


def test_batch_equals_single_queries(spark, store):
    batch = rows(plans.search(store, spark.createDataFrame([(1,), (2,), (9,)], "id long")))
    single = {}
    for q in (1, 2, 9):
        single |= rows(plans.search(store, [q]))
    assert batch.keys() == single.keys()
    for key, row in batch.items():
        assert row["aggregated"] == pytest.approx(single[key]["aggregated"], abs=1e-12)


def test_many_queries_give_the_same_results(spark, store, monkeypatch):
    """The path without any broadcast, taken when the queries are not proven few."""
    queries = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    asked = [lambda: plans.search(store, queries), lambda: plans.search(store, queries, k=4),
             lambda: plans.refine(store, queries, ("js", "rp")), lambda: plans.prefilter(store, queries, candidates=6)]
    few = [rows(ask()) for ask in asked]
    monkeypatch.setattr(pairing, "small_keys", lambda *_: None)
    for ask, want in zip(asked, few):
        got = rows(ask())
        assert got.keys() == want.keys() and want
        assert all(got[k]["aggregated"] == pytest.approx(want[k]["aggregated"], abs=1e-12) for k in got)


def test_many_queries_go_block_by_block(spark, store, monkeypatch, tmp_path):
    """Blocks of eight: each is one pass over the catalogue, without a shuffle of items or queries, and gives what one block gives."""
    store.write.parquet(str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    queries = spark.createDataFrame([(i,) for i in range(30)], "id long")
    names = ["rp", "notes", "chroma", "skl", "js"]
    want = rows(plans.measured(store, queries, names)[0])
    passes = []
    one = measures.measure_block
    for module in (pairing, measures):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 8, raising=False)
    monkeypatch.setattr(pairing, "small_keys", lambda *_: None)
    monkeypatch.setattr(measures, "BLOCKS_A_JOB", 3)
    monkeypatch.setattr(measures, "measure_block", lambda store, points, *a: passes.append((len(points.ids), plan_of(df := one(store, points, *a)))) or df)
    got = rows(plans.measured(store, queries, names)[0])
    assert [n for n, _ in passes] == [8, 8, 8, 6]
    assert all(plan.count("EvalPython") == 1 and "hashpartitioning" not in plan for _, plan in passes)
    assert got.keys() == want.keys() and len(got) == 30 * N
    assert all(got[k][c] == pytest.approx(want[k][c], nan_ok=True) for k in got for c in ("d_rp", "d_notes", "d_chroma", "d_skl", "d_js"))
    assert plans.measured(store, spark.createDataFrame([(-1,)], "id long"), names)[0].collect() == []


def test_joined_and_separate_agree_when_nothing_is_missing(store, tables):
    joined, separate = rows(plans.search(store, [4])), rows(plans.search_tables(served(tables), [4]))
    assert joined.keys() == separate.keys()
    for key in joined:
        assert joined[key]["aggregated"] == pytest.approx(separate[key]["aggregated"], abs=1e-12)


def test_scope_matters_when_a_table_has_more_items(tables):
    fewer = tables["gauss"].filter("id < 20")
    parts = [(t, s) if "mfcc" not in s else (fewer, s) for t, s in served(tables)]
    store = gather([tables["vec"], fewer, tables["notes"], tables["chroma"]])
    joined, separate = rows(plans.search(store, [4])), rows(plans.search_tables(parts, [4]))
    assert len(joined) == len(separate) == 20
    assert any(abs(joined[k]["scaled_rp"] - separate[k]["scaled_rp"]) > 1e-6 for k in joined)


def test_limit_drops_far_items(store):
    everything = plans.search(store, [0], ["skl"]).count()
    d = plans.measured(store, [0], ["skl"])[0].select("d_skl").collect()
    cut = sorted(r.d_skl for r in d)[N // 2]
    assert everything == N and plans.search(store, [0], ["skl"], limits={"skl": cut}).count() == N // 2 + 1


def test_refine_against_plain_python(store):
    """Replays the stages on collected distances."""
    for stages in (plans.BH_FIRST, plans.CHROMA_FIRST, ("js", "rp")):
        d = {r.id: r.asDict() for r in plans.measured(store, [5], list(stages))[0].collect()}
        alive = set(d)
        for n in stages:
            values = {i: d[i][f"d_{n}"] for i in alive if d[i][f"d_{n}"] <= (MEASURES[n].limit or 1e300)}
            mean = sum(values.values()) / len(values) if values else 0
            alive = {i for i, v in values.items() if (v > mean if MEASURES[n].similarity else v < mean)}
        assert {r.id for r in plans.refine(store, [5], stages).collect()} == alive


def test_refine_keeps_the_asked_number(store):
    kept = plans.refine(store, [5], plans.BH_FIRST, min_candidates=4).collect()
    assert len(kept) >= 4


def test_equal_values_leave_nothing(spark, store):
    same = store.withColumn("bh", F.array(F.lit(1.0)))
    assert plans.refine(same, [5], ["bh"]).count() == 0
    scaled = plans.search(same, [5], ["bh"]).collect()
    assert len(scaled) == N and all(r.scaled_bh is None for r in scaled)


def test_prefilter_keeps_the_nearest(store):
    d = sorted((r.d_js, r.id) for r in plans.measured(store, [8], ["js"])[0].collect())
    got = plans.prefilter(store, [8], candidates=10).collect()
    assert {r.id for r in got} == {i for _, i in d[:10]}


def test_top_k(spark, store):
    full = [r.id for r in plans.search(store, [7]).collect()]
    assert [r.id for r in plans.search(store, [7], k=5).collect()] == full[:5]
    queries = spark.createDataFrame([(7,), (8,)], "id long")
    many = plans.search(store, queries, k=5).filter("query_id = 7").collect()
    assert {r.id for r in many} == set(full[:5])


def test_top_k_is_cut_before_the_shuffle(store, spark):
    ranked = plans.search(store, spark.createDataFrame([(7,), (8,)], "id long"), k=5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_weighted_score_ignores_missing(spark):
    df = spark.createDataFrame([(0.5, None), (0.5, 1.0), (None, None)], "scaled_rp double, scaled_rh double")
    got = [r[0] for r in df.coalesce(1).select(ranking.weighted_score({"rp": 3, "rh": 1})).collect()]
    assert got == [0.5, pytest.approx(0.625), None]


def test_ranked_lists_turn_similarities(store):
    d = plans.measured(store, [2], ["rp", "chroma"])[0]
    lists = ranking.ranked_lists(d, ["rp", "chroma"]).collect()
    for name, reverse in (("rp", False), ("chroma", True)):
        ordered = [r.distance for r in sorted((r for r in lists if r.feature == name), key=lambda r: r.position)]
        assert len(ordered) == N and ordered == sorted(ordered, reverse=reverse)


def test_each_kernel_runs_once_and_arrays_are_not_shuffled(store):
    df = distinct_rows(plans.measured(store, [0], list(ALL))[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    shuffled = re.search(r"Exchange hashpartitioning\((.*?), \d+\)", plan).group(1)
    assert {c.split("#")[0] for c in shuffled.split(", ")} == {
        "query_id", "id", "key", "scale", "bpm", *[f"d_{n}" for n in ALL]
    }


def test_statistics_match_builtin(store):
    d = plans.measured(store, [0], ["rp"])[0]
    row, values = scaling.statistics(d, ["rp"]).first(), [r.d_rp for r in d.collect()]
    assert (row.min_rp, row.max_rp) == (min(values), max(values))
    assert row.stddev_rp == pytest.approx(np.std(values, ddof=1))


def test_lsh_finds_most_neighbours(store):
    exact = {r.id for r in plans.measured(store, [0], ["rp"])[0].orderBy("d_rp").limit(10).collect()}
    found = {r.id for r in lsh.approximate_neighbours(store, 0, "rp", 10, bucket_length=1.0, hash_tables=4).collect()}
    assert len(exact & found) >= 7


def test_lsh_join_reports_exact_distances(store, spark):
    points = store.filter("id < 3")
    exact = rows(plans.measured(store, [0, 1, 2], ["rp"])[0])
    pairs = lsh.approximate_join(store, points, "rp", 0.8, bucket_length=1.0).collect()
    assert pairs and all(r.distance < 0.8 for r in pairs)
    assert all(r.distance == pytest.approx(exact[r.query_id, r.id]["d_rp"]) for r in pairs)


def test_lsh_search_covers_the_bucket(store):
    # buckets this wide are only split at zero; with many tables every pair shares one
    got = lsh.approximate_search(store, 0, ("mfcc", "rp"), ("notes",), bucket_length=1000.0, hash_tables=16).collect()
    exact = rows(plans.search(store, [0], "notes_mfcc_rp"))
    assert len(got) == N
    for r in got:
        assert r.aggregated == pytest.approx(exact[0, r.id]["aggregated"])


def test_duplicates_and_consistency(spark, tables):
    vec = tables["vec"].select("id")
    assert [r.id for r in duplicate_ids(vec.union(vec.filter("id = 3"))).collect()] == [3]
    missing = id_consistency({"a": vec, "b": vec.filter("id <> 4")}).collect()
    assert [(r.id, r.in_a, r.in_b) for r in missing] == [(4, True, False)]


def test_repeated_feature_rows_give_one_result(store):
    twice = store.unionByName(store.filter("id < 5"))
    assert plans.search(twice, [0]).count() == N
    assert plans.search(twice, [0], distinct=False).count() == N + 5


def test_copies_do_not_multiply(spark, store, tables):
    """One item holds a third of all rows in every table."""
    def hot(df):
        copies = df.filter("id = 3").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(N // 2)))).drop("_n")
        return df.unionByName(copies)

    copies = {k: hot(v) for k, v in tables.items()}
    many = hot(store)
    for plan in (plans.search, plans.refine, plans.prefilter):
        assert rows(plan(many, [5])).keys() == rows(plan(store, [5])).keys()
        assert plan(many, [5]).count() == plan(store, [5]).count()
    assert plans.search_tables(served(copies), [5]).count() == N
    assert gather(list(copies.values()), distinct=True).count() == N


def test_bucketed_stores_join_without_shuffle(spark, tables):
    names = []
    for key in ("vec", "gauss"):
        name = f"bucketed_{key}"
        spark.sql(f"drop table if exists {name}")
        write_store(tables[key], name, buckets=4)
        names.append(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = gather([spark.table(n) for n in names])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == N
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_lookup_reaches_the_scan(spark, store, tmp_path, monkeypatch):
    store.write.parquet(str(tmp_path / "store"))
    read = spark.read.parquet(str(tmp_path / "store"))
    seen = []
    monkeypatch.setattr(pairing, "materialise", lambda df, name: seen.append(plan_of(df)) or df)
    for queries in ([5], spark.createDataFrame([(5,), (5,)], "id long")):
        pairing.query_points(read, queries, ["rp"])
    assert all("EqualTo(id,5)" in plan and "chroma" not in plan for plan in seen) and len(seen) == 2


def test_filters_drop_infinite_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,), (20000.0,)], "d_skl double")
    assert df.filter(is_comparable("skl")).count() == 1
    assert df.filter(is_comparable("skl", {"skl": 1e9})).count() == 2
    assert reduce(lambda a, b: a & b, [is_comparable("skl")]) is not None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lsh_join_of_many_points_is_the_same(store, monkeypatch):
    twice = store.unionByName(store.filter("id < 20"))
    points = twice.filter("id < 9")
    few = sorted(tuple(r) for r in lsh.approximate_join(twice, points, "rp", 0.8, bucket_length=1.0).collect())
    monkeypatch.setattr(lsh, "broadcast_if_small", lambda df, **_: df)
    many = sorted(tuple(r) for r in lsh.approximate_join(twice, points, "rp", 0.8, bucket_length=1.0).collect())
    assert few and few == many and len({r[:2] for r in few}) == len(few)


def test_lsh_without_the_query(store):
    assert lsh.approximate_neighbours(store, -5, "rp", 3).collect() == []
    assert lsh.approximate_search(store, -5, ("rp",), ("notes",)).collect() == []
    assert lsh.approximate_join(store.limit(0), store, "rp", 1.0).collect() == []


def test_no_bucket_holds_a_tenth(spark):
    from checks import inputs

    vectors = lsh._vectors(inputs.vec(spark, "/root/testdata/sf0.01"), "rp")
    dim = lsh.dimension(vectors)
    n = vectors.count()
    sizes = lsh.entries(vectors, dim, lsh.width_of(vectors, dim), 4).groupBy("_table", "_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= n / 10


def test_lsh_recall(spark):
    from checks import inputs

    vec = inputs.vec(spark, "/root/testdata/sf0.01")
    exact = {r.id for r in plans.measured(vec, [0], ["rp"])[0].orderBy("d_rp").limit(10).collect()}
    found = {r.id for r in lsh.approximate_neighbours(vec, 0, "rp", 10, hash_tables=48).collect()}
    assert len(exact & found) >= 9


def test_weights_choose_the_distances(store):
    got = plans.search(store, [0], weights={"rp": 1.0}).first()
    assert "scaled_rp" in got.asDict() and "scaled_bh" not in got.asDict()
    with pytest.raises(ValueError):
        plans.search(store, [0], "fast", weights={"rp": 1.0})
    with pytest.raises(ValueError):
        plans.search(store, [0], missing="maybe")


def test_items_with_missing_features_can_stay(store):
    holed = store.withColumn("notes", F.when(F.col("id") % 2 == 0, F.col("notes"))).withColumn("mean", F.when(F.col("id") != 7, F.col("mean")))
    names = ["rp", "notes", "mfcc"]
    assert plans.search(holed, [0], names).count() < N
    kept = {r.id: r for r in plans.search(holed, [0], names, missing="keep").collect()}
    assert len(kept) == N and kept[7].aggregated == pytest.approx(kept[7].scaled_rp)
    assert plans.search(holed, [0], weights={"rp": 1.0}).count() == N


def test_stages_of_the_jvm_are_measured_together():
    assert plans.stage_runs(plans.BH_FIRST) == [["bh", "rh", "notes", "rp"], ["js"], ["skl"], ["mfcc"], ["chroma"]]


def test_refining_a_bucketed_store_shuffles_no_arrays(spark, store):
    spark.sql("drop table if exists bucketed_store")
    write_store(store, "bucketed_store", buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        survivors = plans.measured(store, [0], ["bh"])[0].select("id")
        joined = spark.table("bucketed_store").select("id", "chroma").join(survivors, "id")
        exchanges = [line for line in plan_of(joined).splitlines() if "Exchange" in line]
        scan = plan_of(joined).split("bucketed_store")[0]
        assert "Exchange" not in scan and len(exchanges) >= 1
        got = {r.id for r in plans.refine(spark.table("bucketed_store"), [5], ("js", "rp")).collect()}
        assert got == {r.id for r in plans.refine(store, [5], ("js", "rp")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists bucketed_store")


def test_items_go_to_python_once(store, spark):
    """One row per item below the explode, whatever the number of queries; the same distances as pair by pair."""
    distances, few = plans.measured(store, [0, 1, 2, 3], ["rp", "chroma", "skl", "js"])
    plan = plan_of(distances)
    assert few and plan.index("Generate") < plan.index("EvalPython")
    points = pairing.query_points(store, [0, 1, 2, 3], ["rp", "chroma", "mean", "cov"])
    plain = rows(plans.measure(pairing.pair(store, points), ["rp", "chroma", "skl", "js"]))
    got = rows(distances)
    assert got.keys() == plain.keys() and len(got) == 4 * N
    for key, row in got.items():
        assert all(row[c] == pytest.approx(plain[key][c], nan_ok=True) for c in ("d_rp", "d_chroma", "d_skl", "d_js"))


def test_lsh_recall_of_the_defaults(spark):
    from checks import inputs

    vec = inputs.vec(spark, "/root/testdata/sf0.01").cache()
    ids = sorted(r.id for r in vec.select("id").collect())[::50]
    exact = plans.measured(vec, ids, ["rp"])[0].collect()
    points = vec.filter(F.col("id").isin(ids))
    met = {(r.query_id, r.id) for r in lsh.approximate_join(vec, points, "rp", float("inf")).collect()}
    nearest = [(q, r.id) for q in ids for r in sorted((r for r in exact if r.query_id == q), key=lambda r: (r.d_rp, r.id))[:10]]
    assert np.mean([pair in met for pair in nearest]) >= 0.9
    found = {r.id for r in lsh.approximate_neighbours(vec, ids[0], "rp", 10).collect()}
    assert len(found & {i for q, i in nearest if q == ids[0]}) >= 9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lsh_measures_a_fifth_and_finds_nine_of_ten(spark, sf):
    """At the registered parameters and at the defaults, over all rows with an id divisible by 50."""
    from checks import inputs, searching

    vec = inputs.vec(spark, f"/root/testdata/{sf}").cache()
    n, points = vec.count(), vec.filter("id % 50 = 0")
    exact = lsh.approximate_join(vec, points, "rp", float("inf"), bucket_length=1000.0).collect()
    assert len(exact) == n * points.count()
    nearest = {}
    for r in sorted(exact, key=lambda r: (r.distance, r.id)):
        nearest.setdefault(r.query_id, []).append(r.id)
    for options in ({"bucket_length": searching._RP_WIDTH, "share": searching._SHARE}, {}):
        met = {(r.query_id, r.id) for r in lsh.approximate_join(vec, points, "rp", float("inf"), **options).collect()}
        assert len(met) <= 0.2 * len(exact)
        assert np.mean([(q, i) in met for q, ids in nearest.items() for i in ids[:10]]) >= 0.9
    wide = {(r.query_id, r.id) for r in lsh.approximate_join(vec, points, "rp", 8.0, bucket_length=searching._RP_WIDTH).collect()}
    assert len(wide) >= 0.9 * len(exact)


def test_lsh_search_finds_the_best_rows(spark):
    from checks import inputs, searching

    store = inputs.stored(spark, "/root/testdata/sf0.1")
    ids = [r.id for r in store.filter("id % 100 = 0").select("id").collect()]
    queries = spark.createDataFrame([(i,) for i in ids], "id long")
    widths = {"mfcc": searching._MFCC_WIDTH, "rp": searching._RP_WIDTH}
    best = {(r.query_id, r.id) for r in plans.search(store, queries, "notes_mfcc_rp", k=10).collect()}
    for options in ({"bucket_length": widths, "share": searching._SEARCH_SHARE}, {}):
        got = lsh.approximate_search(store, queries, ("mfcc", "rp"), ("notes",), **options)
        found = {(r.query_id, r.id) for r in got.collect()}
        assert len(found) <= 0.3 * store.count() * len(ids)
        assert len(found & best) >= 0.9 * len(best)


def test_lsh_of_equal_vectors_deals_out_the_bucket(spark, monkeypatch):
    """A third of the rows stand in one bucket of every table; the query buckets are too many to broadcast."""
    rng = np.random.default_rng(4)
    same = rng.random(6).tolist()
    rows = [(i, same if i < 100 else rng.random(6).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, rp array<double>")
    points = table.filter("id < 3 or id > 290")
    few = sorted(tuple(r) for r in lsh.approximate_join(table, points, "rp", 0.5, share=0.5).collect())
    monkeypatch.setattr(lsh, "ASKED_ROWS", 10)
    monkeypatch.setattr(lsh, "BUCKET_ROWS", 20)
    many = lsh.approximate_join(table, points, "rp", 0.5, share=0.5)
    assert sorted(tuple(r) for r in many.collect()) == few
    assert {i for q, i, _ in few if q == 0} >= set(range(100))


def test_lsh_index_can_be_made_before(spark, store):
    held = lsh.index(store, "rp")
    got = lsh.approximate_neighbours(store, 3, "rp", 5, held=held).collect()
    assert got == lsh.approximate_neighbours(store, 3, "rp", 5).collect() and got[0].id == 3
    odd = store.select("id", "rp").unionByName(spark.createDataFrame([(900, None), (901, [1.0]), (902, [])], "id long, rp array<double>"))
    assert {r.id for r in lsh.approximate_join(odd, odd, "rp", 9.0, bucket_length=50.0).collect()} == set(range(N))


def test_a_catalogue_without_copies_is_not_searched_for_them(spark, store, tmp_path):
    store.write.parquet(str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    known = Catalogue(store, True, N, {})
    copies = Catalogue(store.unionByName(store.filter("id < 5")), False, N + 5, {})
    want = rows(plans.search(store, [0]))
    for asked in (known, copies):
        got = rows(plans.search(asked, [0]))
        assert got.keys() == want.keys() and all(got[k]["aggregated"] == pytest.approx(want[k]["aggregated"]) for k in got)
    seen = []
    for asked in (known, copies):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(plans, "materialise", lambda df, name: seen.append((asked.unique, name, plan_of(df))) or materialise(df, name))
            plans.search(asked, [0])
            plans.refine(asked, [0], ("bh", "rh"))
    # Not the cuts of refining, whose bounds meet by query.
    measured = [(unique, plan) for unique, name, plan in seen if name in ("distances", "stage") and "min_" not in plan]
    assert all("hashpartitioning" not in plan for unique, plan in measured if unique)
    assert any("hashpartitioning" in plan for unique, plan in measured if not unique)


def test_few_survivors_are_looked_up_in_the_scan(spark, store, tmp_path):
    store.write.parquet(str(tmp_path / "store"))
    read = spark.read.parquet(str(tmp_path / "store"))
    few = store.filter("id in (3, 5)").select("id")
    assert "In(id, [3,5])" in plan_of(plans._survivors_of(read, few))
    assert {r.id for r in plans._survivors_of(read, few).collect()} == {3, 5}
    assert plans._survivors_of(read, few.limit(0)).collect() == []


def test_a_limit_of_the_edit_distance_spares_work(spark, store):
    """Same rows as without the bound; sequences of other lengths are not compared at all, the rest within a band."""
    longer = store.withColumn("notes", F.concat("notes", F.repeat(F.lit("A"), (F.col("id") % 10).cast("int"))))
    limit = 9
    plain = plans.measured(longer, [0], ["notes", "rp"])[0].filter(F.col("d_notes") <= limit).collect()
    bounded = plans.measured(longer, [0], ["notes", "rp"], {"notes": limit})[0]
    assert f"Some({limit})" in plan_of(bounded)
    assert sorted(bounded.filter("d_notes is not null").collect()) == sorted(plain) and 0 < len(plain) < N
    lengths = {r.id: len(r.notes) for r in longer.collect()}
    assert sum(abs(n - lengths[0]) > 4 for n in lengths.values()) == N // 2
    assert plans.measured(longer, [0], ["notes"], {"notes": 4})[0].filter("d_notes is not null").count() <= N // 2
    for plan in (plans.search, plans.refine):
        names = ("notes", "rp")
        got = rows(plan(longer, [0], names, limits={"notes": limit}))
        with pytest.MonkeyPatch.context() as m:
            m.setitem(MEASURES, "notes", replace(MEASURES["notes"], within=None))
            want = rows(plan(longer, [0], names, limits={"notes": limit}))
        assert got.keys() == want.keys() and all(got[k]["aggregated"] == pytest.approx(want[k]["aggregated"]) for k in got)


def test_scores_that_differ_by_round_off_are_ranked_by_id(spark):
    """Sums taken in another order differ in the last digits; the ranking must not."""
    for noise in (1e-16, 2e-13, -2e-13):
        rows_ = spark.createDataFrame([(0, 7, 0.3 + noise), (0, 3, 0.3), (0, 5, 0.3 - noise), (0, 9, 0.2), (0, 1, None)], "query_id long, id long, aggregated double")
        assert [r.id for r in rows_.orderBy(*ranking.order_columns()).collect()] == [9, 3, 5, 7, 1]
        for few in ([0], None):
            assert {r.id for r in ranking.top_k(rows_, 2, few).collect()} == {9, 3}


@pytest.mark.parametrize("share", [0.2, None])
def test_lsh_of_many_queries_writes_no_row_for_each_pair(spark, monkeypatch, share):
    """Many queries give the pairs that few do, from a table of counts and near pairs instead of all that share a bucket."""
    vec = inputs.vec(spark, "/root/testdata/sf0.01").select("id", "rp")
    odd = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [float("nan")] * 40)], "id long, rp array<double>")
    table = vec.unionByName(odd)
    points = table.filter("id % 5 = 0 or id < 0")
    options = {"bucket_length": searching._RP_WIDTH, "share": share}
    few = sorted(tuple(r) for r in lsh.approximate_join(table, points, "rp", 0.9, **options).collect())
    written, write = {}, lsh.materialise

    def counted(df, name):
        written[name] = written.get(name, 0) + (out := write(df, name)).count()
        return out

    monkeypatch.setattr(lsh, "materialise", counted)
    monkeypatch.setattr(lsh, "ASKED_ROWS", 10)
    monkeypatch.setattr(lsh, "JOB_QUERIES", 40)
    monkeypatch.setattr(lsh, "ASKED_TOGETHER", 16)
    monkeypatch.setattr(lsh, "ITEMS_TOGETHER", 37)
    many = sorted(tuple(r) for r in lsh.approximate_join(table, points, "rp", 0.9, **options).collect())
    assert few and [r[:2] for r in many] == [r[:2] for r in few]
    assert [r[2] for r in many] == pytest.approx([r[2] for r in few])
    assert sum(written.values()) < 0.5 * vec.count() * points.count()
    twice = table.unionByName(vec.filter("id < 20").withColumn("rp", F.reverse("rp")))
    assert {r[:2] for r in few if share is None} <= {tuple(r)[:2] for r in lsh.approximate_join(twice, points, "rp", 0.9, **options).collect()}
