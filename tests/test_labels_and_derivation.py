"""Labels, classification, evaluation and frame features on small inputs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import classify, derive, evaluate, labels, linear_models


def test_classes_from_ids(spark):
    df = spark.createDataFrame([("pop/a",), ("pop/b",), ("rock/c",)], "id string")
    assert {r["class"] for r in labels.classes_from_ids(df).collect()} == {"pop", "rock"}
    with pytest.raises(ValueError):
        labels.classes_from_ids(spark.createDataFrame([("a/1",), ("b/2",)], "id string"))


def test_encoding_round_trip(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, class string")
    codes = labels.encoder(df)
    assert {r["class"]: r.code for r in codes.collect()} == {"a": 0, "b": 1}
    assert {r.id: r.code for r in labels.encode(df, codes).collect()} == {1: 1, 2: 0, 3: None}


def test_align_checks_duplicates_and_columns(spark):
    left = spark.createDataFrame([("x/A.mp3", 1), ("y/a.wav", 2)], "id string, v int")
    right = spark.createDataFrame([("a", 5)], "id string, w int")
    with pytest.raises(ValueError, match="duplicate id"):
        labels.align(left, right, strip=True, lower=True)
    assert labels.align(left, right, strip=True).count() == 1
    with pytest.raises(ValueError, match="different columns"):
        labels.align_predictions(left, right)


def test_match_report(spark):
    a, b = spark.range(0, 4), spark.range(2, 6)
    got = {r.id: r.status for r in labels.match_report(a, b).collect()}
    assert got == {0: "only_features", 1: "only_features", 2: "both", 3: "both", 4: "only_classes", 5: "only_classes"}


def test_minimum_members_and_baseline(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else f"c{i}") for i in range(6)], "id int, class string")
    assert sorted(r.id for r in labels.at_least(df, 2).collect()) == [0, 1, 2]
    assert labels.majority_baseline(df).first().baseline == pytest.approx(0.5)
    some = spark.createDataFrame([("c4",)], "class string")
    assert [r.id for r in labels.restrict_to_classes(df, some).collect()] == [4]


def test_standardise(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 5, size=(40, 3))
    x[:, 2] = 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, v array<double>")
    got = np.array([r.v for r in classify.standardise(df, "v").orderBy("id").collect()])
    want = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    assert np.allclose(got, want)


def test_classifier_learns_saves_and_checks_dimensions(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    data = [(i, (centres[i % 3] + rng.normal(size=2)).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(data, "id int, v array<double>, class int").coalesce(1).cache()
    model = classify.train(df, "v", "class", iterations=8)
    classify.save_model(model, str(tmp_path / "m"))
    again = classify.load_model(str(tmp_path / "m"))
    assert classify.accuracy(classify.predict(again, df, "v", "class"), "class").first().accuracy > 0.9
    with pytest.raises(ValueError, match="dimensions"):
        classify.predict(model, df.withColumn("v", F.array(F.lit(1.0))), "v", "class")
    folds = classify.cross_validate(df, "v", "class", folds=2, iterations=5).collect()
    assert len(folds) == 2 and all(r.accuracy > 0.8 for r in folds)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 6)) * 2
    data = [(i, (centres[i % 4] + rng.normal(size=6)).tolist(), f"class {i % 4}") for i in range(400)]
    return spark.createDataFrame(data, "id long, v array<double>, class string").repartition(7).cache()


def test_folds_are_dealt_within_classes(spark, points):
    odd = points.filter("id % 4 < 3 or id < 20").unionByName(points.filter("id = 0"))
    dealt = linear_models.stratified_folds(odd, "class", 3)
    assert dealt.count() == odd.count() and dealt.filter("id = 0").select("fold").distinct().count() == 1
    counts = {}
    for r in dealt.dropDuplicates(["id"]).groupBy("class", "fold").count().collect():
        counts.setdefault(r["class"], {0: 0, 1: 0, 2: 0})[r.fold] = r["count"]
    assert len(counts) == 4 and all(max(c.values()) - min(c.values()) <= 1 for c in counts.values())
    assert linear_models.stratified_folds(odd.limit(0), "class", 3).collect() == []


def test_all_folds_and_classes_are_trained_by_one_pass_an_iteration(spark, points):
    """Every model ends where its loss, over the rows it may see, has no slope left."""
    rows = points.withColumn("fold", (F.col("id") % 3).cast("int"))
    models = linear_models.train_together(rows, "v", "class", "fold", 3, iterations=60)
    assert models.passes == 61 and models.weights.shape == (3, 4, 6)
    table = rows.toPandas()
    x_all = np.array(table.v.tolist())
    for fold in range(3):
        x = x_all[table.fold != fold]
        mean, std = x.mean(0), x.std(0)
        z = (x - mean) / std
        for c, name in enumerate(models.classes):
            y = np.where(table["class"][table.fold != fold] == name, 1, -1)
            w = models.weights[fold, c] * std
            b = models.bias[fold, c] + models.weights[fold, c] @ mean
            short = np.maximum(0, 1 - y * (z @ w + b))
            assert np.abs(-2 * (y * short) @ z / len(y) + linear_models.REGULARISATION * w).max() < 1e-6
            assert abs((y * short).mean()) < 1e-6
    judged = linear_models.predict_together(models, rows, "v", "fold").toPandas()
    margins = np.einsum("nd,ncd->nc", np.array(judged.v.tolist()), models.weights[judged.fold]) + models.bias[judged.fold]
    assert (judged.predicted == np.array(models.classes)[margins.argmax(1)]).all()
    scores = {r.fold: r.f1 for r in classify.cross_validate(points, "v", "class", 3, 60, "f1", (F.col("id") % 3).cast("int")).collect()}
    for fold, part in judged.groupby("fold"):
        by_hand = 0
        for name in models.classes:
            hit = ((part["class"] == name) & (part.predicted == name)).sum()
            p, r = hit / max(1, (part.predicted == name).sum()), hit / (part["class"] == name).sum()
            by_hand += (2 * p * r / (p + r) if p + r else 0) * (part["class"] == name).mean()
        assert scores[fold] == pytest.approx(by_hand)


def test_rows_that_cannot_be_learnt_from(spark, points):
    odd = points.unionByName(spark.createDataFrame([(900, None, "class 1"), (901, [1.0], "class 1"), (902, [0.0] * 6, None)], "id long, v array<double>, class string"))
    models = linear_models.train_together(odd, "v", "class", iterations=5)
    same = linear_models.train_together(points, "v", "class", iterations=5)
    assert np.allclose(models.weights, same.weights)
    judged = {r.id: r.predicted for r in linear_models.predict_together(models, odd, "v").collect()}
    assert judged[900] is judged[901] is None and judged[902] is not None and len(judged) == 403
    none = linear_models.train_together(points.limit(0), "v", "class")
    assert none.passes == 0 and {r.predicted for r in linear_models.predict_together(none, points, "v").collect()} == {None}


def test_evaluation_by_hand(spark):
    results = spark.createDataFrame(
        [(0, 0, 0.0), (0, 1, 0.1), (0, 2, 0.2), (1, 0, 0.1), (1, 1, 0.0), (1, 2, 0.3)], "query_id int, id int, scaled_rp double")
    classes = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id int, class string")
    scored = evaluate.rescore(evaluate.with_classes(results, classes), ["rp"])
    assert {(r.query_id, r.id) for r in evaluate.neighbours(scored, 1).collect()} == {(0, 1), (1, 0)}
    assert evaluate.hits(evaluate.neighbours(scored, 1)).first().hits == 2
    assert evaluate.precision(evaluate.neighbours(scored, 2)).first().precision == 0.5
    found = {(r.true_class, r.found_class): r["count"] for r in evaluate.confusion(evaluate.neighbours(scored, 2)).collect()}
    assert found == {("a", "a"): 2, ("a", "b"): 2}


def test_common_key(spark):
    df = spark.createDataFrame([(k, b) for k in ("A", "C", "G#", "Ab") for b in range(12)], "k string, b int")
    for r in df.select("k", "b", derive.to_common_key(F.col("b"), F.col("k")).alias("n")).collect():
        assert r.n == (r.b - {"A": 0, "C": 3, "G#": 11, "Ab": 11}[r.k]) % 12


def frames(spark, values, beats):
    rows = [("t", i, v, i in beats) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "track string, frame int, values array<double>, is_beat boolean")


def test_beat_averages_by_hand(spark):
    values = [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0], [4.0, 4.0]]
    got = derive.beat_averages(derive.with_intervals(frames(spark, values, {2, 4}), ["frame"]), 2).collect()
    # frames 0-1 end at beat 2, frames 2-3 at beat 4; frame 4 follows the last beat
    assert {r.interval: r["values"] for r in got} == {0: [0.5, 0.5], 1: [0.0, 0.0]}


def test_dominant_bins_by_hand(spark):
    values = [[0.2, 0.9, 1.0], [0.1, 0.85, 0.5], [0.01, 0.0, 0.0], [1.0, 1.0, 0.0]]
    got = derive.dominant_bins(derive.with_intervals(frames(spark, values, {2, 3}), ["frame"]), 3).collect()
    # peaks (0, .9, 1) + (0, 1, 0); the second interval is silent
    assert {r.interval: r.note for r in got} == {0: 1, 1: 0}


def test_rhythm_histogram(spark):
    matrix = np.arange(24.0).reshape(4, 6) - 10  # 4 bands x 6 bins
    df = spark.createDataFrame([(matrix.flatten("F").tolist(),)], "p array<double>")
    assert df.select(derive.rhythm_histogram(F.col("p"), 4, 6)).first()[0] == np.abs(matrix).sum(0).tolist()


def test_band_sums_are_half_open(spark):
    df = spark.createDataFrame([("a", x, 1.0) for x in (-1.0, 0.0, 4.9, 5.0, 9.9, 10.0)], "g string, x double, v double")
    got = {r.band: r.total for r in derive.band_sums(df, ["g"], "x", "v", [0, 5, 10]).collect()}
    assert got == {0: 2.0, 1: 2.0}


def test_seven_statistics_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 4, "g string, x double")
    row = derive.seven_statistics(df, ["g"], "x").first()
    assert (row["skew"], row["kurtosis"], row["median"], row["mean"], row["var"]) == (0.0, 0.0, 2.0, 2.0, 0.0)


def test_measures_without_an_error_are_exactly_one():
    """Shares of the classes, added up one by one, gave 0.9999999999999999."""
    for sizes in ([67, 62, 71, 66, 68, 64, 63, 70, 69, 67], [1] * 10, [3, 7], range(1, 50)):
        counts = {(c, c): n for c, n in enumerate(sizes)}
        assert set(linear_models.measures_of(counts).values()) == {1.0}
    assert linear_models.measures_of({("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 2})["accuracy"] == 0.75
    assert set(linear_models.measures_of({}).values()) == {0.0}


def test_memory_of_a_pass_does_not_grow_with_the_batch():
    rng = np.random.default_rng(1)
    weights, bias = rng.standard_normal((30, 50)), np.zeros((3, 10))

    def peak(rows):
        x = pa.FixedSizeListArray.from_arrays(pa.array(rng.standard_normal(rows * 50)), 50).cast(pa.list_(pa.float64()))
        batch = pa.record_batch([x, pa.array(rng.integers(0, 10, rows), pa.int32()), pa.array(rng.integers(0, 3, rows), pa.int32())], names=["x", "code", "fold"])
        tracemalloc.start()
        sums = linear_models._sums(iter([batch]), weights, bias)
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        parts = [linear_models._sums(iter([batch.slice(at, 700)]), weights, bias) for at in range(0, rows, 700)]
        assert np.allclose(sums, np.sum(parts, axis=0))
        return most

    assert peak(20_000) < 1.5 * peak(1000)
