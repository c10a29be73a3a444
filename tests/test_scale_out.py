"""Operators that must not depend on group size or on the number of queries."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import pairing, scale_out


def test_running_total_with_a_hot_group(spark):
    rows = [("hot", i, i % 3) for i in range(2000)] + [(f"g{i % 40}", 10_000 + i, i % 5) for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): r.t for r in scale_out.running_total(df, ["g"], ["i"], F.col("v"), "t").collect()}
    sums, want = {}, {}
    for g, i, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[g, i] = sums[g]
    assert got == want


def test_hot_group_is_spread_over_partitions(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = df.repartitionByRange("g", "i").withColumn("p", F.spark_partition_id())
        assert cut.select("p").distinct().count() == 8
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_position_without_groups_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, i int")
    assert sorted((r.i, r.position) for r in scale_out.running_total(df, [], ["i"]).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sorted((r.i, r.position) for r in scale_out.running_total(df, ["g"], ["i"]).collect()) == [(1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_exact_median(spark, n):
    rng = random.Random(n)
    rows = [(g, float(rng.randint(0, 5))) for g in ("a", "b") for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r["median"] for r in scale_out.exact_median(df, ["g"], "x").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert got == want


def test_small_keys_checks_rows_and_bytes(spark):
    df = spark.range(10).withColumn("a", F.array_repeat(F.lit(1.0), 100))
    assert sorted(scale_out.small_keys(df, "id")) == list(range(10))
    assert scale_out.small_keys(df, "id", max_rows=9) is None
    assert scale_out.small_keys(df, "id", max_bytes=1000) is None


def test_pairs_are_the_same_with_and_without_broadcast(spark):
    store = spark.range(50).withColumn("x", F.col("id") * 2.0)
    few = pairing.query_points(store, [1, 5, 7], ["x"])
    many = pairing.query_points(store, spark.createDataFrame([(1,), (5,), (7,)], "id long"), ["x"], max_rows=1)
    assert few.ids is not None and many.ids is None
    columns = ["query_id", "id", "x", "q_x"]
    a, b = (sorted(map(tuple, pairing.pair(store, p).select(columns).collect())) for p in (few, many))
    assert a == b and len(a) == 150


def test_many_queries_need_no_cross_join(spark):
    store = spark.range(50).withColumn("x", F.col("id") * 2.0)
    points = pairing.query_points(store, [1, 5, 7], ["x"], max_rows=1)
    plan = pairing.pair(store, points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scratch_folder_is_the_one_of_the_session(spark):
    path = scale_out.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_a_hot_track_does_not_meet_on_its_key(spark):
    """A third of all frames are of one track: what follows the running total shuffles partial aggregates only."""
    from kindred.operators import derive

    frames = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("track"), F.col("id").alias("at"),
        (F.col("id") % 7 == 0).alias("is_beat"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("values"),
    )
    intervals = derive.with_intervals(frames, ["at"])
    plan = intervals._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(track" not in plan
    assert intervals.filter("track = 0 and complete").count() == 994
    silent = {r.silence for r in intervals.filter("track = 0").select("silence").distinct().collect()}
    assert silent == {(sum(range(1000)) + 1000) / 1000 * 0.5}
