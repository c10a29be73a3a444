"""Kernels against plain numpy on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import correlation as C
from kindred.functions import distances as D
from kindred.functions.gaussian import jensen_shannon, symmetric_kullback_leibler

rng = np.random.default_rng(3)


def gaussian(d=13, bad=None):
    a = rng.normal(size=(d, d))
    cov = a @ a.T + np.eye(d)
    if bad == "negative":
        cov = -cov
    if bad == "nan":
        cov[0, 0] = np.nan
    return rng.normal(size=d), cov


def skl(m1, s1, m2, s2):
    i1, i2 = np.linalg.inv(s1), np.linalg.inv(s2)
    g = m1 - m2
    return 0.25 * (np.trace(s1 @ i2) + np.trace(s2 @ i1) + g @ (i1 + i2) @ g - 2 * len(m1))


def js(m1, s1, m2, s2):
    m = (m1 + m2) / 2
    mix = (s1 + np.outer(m1, m1)) / 2 + (s2 + np.outer(m2, m2)) / 2 - np.outer(m, m)
    det = lambda s: np.linalg.slogdet(s)[1]
    return 0.5 * det(mix) - 0.25 * det(s1) - 0.25 * det(s2)


def gaussians_frame(spark, pairs):
    rows = [(i, *[x.ravel().tolist() for x in (*a, *b)]) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, m1 array<double>, s1 array<double>, m2 array<double>, s2 array<double>")
    args = ("m1", "s1", "m2", "s2")
    return df.select("i", symmetric_kullback_leibler(*args).alias("skl"), jensen_shannon(*args).alias("js"),
                     D.gaussian_euclidean(*[F.col(c) for c in args]).alias("e")).orderBy("i").collect()


def test_gaussian_divergences(spark):
    pairs = [(gaussian(), gaussian()) for _ in range(20)] + [(gaussian(2), gaussian(2))]
    for (a, b), row in zip(pairs, gaussians_frame(spark, pairs)):
        assert row.skl.distance == pytest.approx(skl(*a, *b), rel=1e-9)
        assert row.js.distance == pytest.approx(js(*a, *b), rel=1e-9)
        assert row.skl.status == row.js.status == "ok"
        upper = np.triu_indices(len(a[0]))
        want = np.linalg.norm(np.concatenate([a[0] - b[0], a[1][upper] - b[1][upper]]))
        assert row.e == pytest.approx(want)


def test_gaussian_self_and_symmetry(spark):
    a, b = gaussian(), gaussian()
    same, ab, ba = gaussians_frame(spark, [(a, a), (a, b), (b, a)])
    assert same.skl.distance == pytest.approx(0, abs=1e-9) and same.js.distance == pytest.approx(0, abs=1e-9)
    assert ab.skl.distance == pytest.approx(ba.skl.distance) and ab.js.distance == pytest.approx(ba.js.distance)


def test_bad_covariances_are_infinite_and_counted(spark):
    good = gaussian()
    pairs = [(good, gaussian()), (gaussian(bad="negative"), good), (good, gaussian(bad="nan")), (good, good)]
    rows = gaussians_frame(spark, pairs)
    assert [math.isinf(r.skl.distance) for r in rows] == [False, True, True, False]
    assert [r.js.status for r in rows][1:3] == ["not_positive_definite", "nan"]


def test_missing_gaussian_is_null(spark):
    df = spark.createDataFrame([([1.0], [1.0], None, None)], "a array<double>, b array<double>, c array<double>, d array<double>")
    assert df.select(jensen_shannon("a", "b", "c", "d").alias("x")).first().x is None


def test_upper_triangle_keeps_row_major_order(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0, 4.0])], "m array<double>, c array<double>")
    assert df.select(D.gaussian_vector(F.col("m"), F.col("c"))).first()[0] == [1.0, 2.0, 1.0, 2.0, 4.0]


def test_edit_distance_threshold(spark):
    df = spark.createDataFrame([("ABCDE", "ABXDE"), ("AAAA", "BBBB")], "a string, b string")
    rows = df.select(D.edit_distance(F.col("a"), F.col("b")), D.edit_distance(F.col("a"), F.col("b"), 2)).collect()
    assert [tuple(r) for r in rows] == [(1.0, 1.0), (4.0, -1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_edit_distance_against_the_table(spark, seed):
    texts = ["", *["".join(np.random.default_rng(seed + k).choice(list("ABC"), k)) for k in range(0, 24, 3)]]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", D.edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        row = list(range(len(r.b) + 1))
        for i, x in enumerate(r.a, 1):
            row = _next_row(row, x, r.b, i)
        assert r.d == row[-1]


def _next_row(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


# --- correlation -------------------------------------------------------------------------------
def high_pass(x):
    y, last_x, last_y = [], 0.0, 0.0
    for v in x:
        last_y = 0.7265425280 * last_y + 0.8632712640 * (v - last_x)
        last_x = v
        y.append(last_y)
    return max(y)


def full_2d(a, v):
    """Brute force: rows are pitches, columns are beats."""
    m, n = a.shape[1], v.shape[1]
    out = np.zeros((23, m + n - 1))
    for i in range(23):
        for k in range(m + n - 1):
            for r in range(12):
                for t in range(n):
                    p, b = r + i - 11, t + k - (n - 1)
                    if 0 <= p < 12 and 0 <= b < m:
                        out[i, k] += a[p, b] * v[r, t]
    return out


def longest(x, y):
    return (x, y) if x.shape[1] > y.shape[1] else (y, x)


def expected(x, y):
    a, v = longest(x.reshape(12, -1), y.reshape(12, -1))
    m, n = a.shape[1], v.shape[1]
    full = full_2d(a, v)
    numpy_same = sum(np.correlate(a[r], v[r], "same") for r in range(12))
    ta, tv = longest(x.reshape(-1, 12).T, y.reshape(-1, 12).T)
    tall = full_2d(ta, tv)
    as_given = full_2d(x.reshape(-1, 12).T, y.reshape(-1, 12).T)
    same = slice(n // 2, n // 2 + m)
    line = full[11, same]
    return {
        C.chroma_correlation: high_pass(numpy_same - numpy_same[0]),
        C.correlation_maximum_same: full[6:18, same].max(),
        C.correlation_peak_line: high_pass(tall[np.unravel_index(tall.argmax(), tall.shape)[0]]),
        C.correlation_fixed_line: as_given[12].max(),
        C.correlation_maximum_full: as_given.max(),
        C.correlation_per_length: tall[12, same].max() / n,
        C.correlation_unshifted: high_pass(line - line[0]),
    }


def test_correlations_against_brute_force(spark):
    lengths = [(1, 1), (5, 5), (7, 4), (4, 7), (9, 2), (33, 12), (6, 5), (5, 6)]
    pairs = [(rng.random(12 * s), rng.random(12 * t)) for s, t in lengths]
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(pairs)],
                               "i int, x array<double>, y array<double>").coalesce(1)
    kernels = list(expected(*pairs[0]))
    rows = df.select("i", *[k("x", "y").alias(f"k{n}") for n, k in enumerate(kernels)]).orderBy("i").collect()
    for (x, y), row in zip(pairs, rows):
        want = expected(x, y)
        for n, k in enumerate(kernels):
            assert row[f"k{n}"] == pytest.approx(want[k], rel=1e-9, abs=1e-9), (n, len(x), len(y))


def test_correlation_of_missing_rows_is_null(spark):
    rows = [(0, [1.0] * 12, [1.0] * 24), (1, None, [1.0] * 12), (2, [], [1.0] * 12)]
    df = spark.createDataFrame(rows, "i int, x array<double>, y array<double>").coalesce(1)
    values = [r[0] for r in df.orderBy("i").select(C.chroma_correlation("x", "y")).collect()]
    assert values[0] is not None and values[1:] == [None, None]


def test_long_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 12 * 64)
    pairs = [(rng.random((12, 20)), rng.random((12, 9))) for _ in range(10)]
    lines = C._lines(pairs, range(0, 1))
    for (a, v), line in zip(pairs, lines):
        assert np.allclose(line[0], full_2d(a, v)[11])
