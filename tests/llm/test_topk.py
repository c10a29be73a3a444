"""Pivot elimination against sorting all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import topk as T


def brute(rows, scale=64, k=20, every=20):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [list(x) for x in {(i, tuple(v)) for i, v in ok}]
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=20, every=20, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    out = T.top_k(T.quantised(df), F.col("vec_id") % every == 0, k=k, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 64).tolist()) for i in range(300)]
    rows += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (440, [0.0] * 3), (441, [1.0] * 3), (None, [0.1] * 6), (460, [])]
    rows += [(20, rows[20][1])]
    assert found(spark, rows) == brute(rows)


def test_copies_of_an_id_take_one_place(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 6) / 64).tolist()) for i in range(100)]
    copies = rows + [(1000, [1.0] * 6)] * 25
    several = rows + [(1000, [1.0 + n / 64] * 6) for n in range(25)] + [(20, [n / 64] * 6) for n in range(30)]

    def top(rows, **options):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        out = T.top_k(T.quantised(df), F.col("vec_id") % 20 == 0, **options).collect()
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)

    assert top(copies) == brute(copies)
    best = {}
    for q, v in several:
        for i, w in several if q % 20 == 0 else ():
            if i != q:
                score = sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True))
                best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, score))
    expected = [(q, n, i, s) for q, found in best.items() for n, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:20], 1)]
    assert top(several) == sorted(expected) == top(several, block_bytes=8 * 24 * 16)


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    assert found(spark, rows, every=2, k=5, block_bytes=8 * 24 * 16) == brute(rows, every=2, k=5)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**40 + i * 2**20 + 1), -float(2**39 + i)]) for i in range(40)]
    reach = [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in brute(rows, k=3)]
    got = found(spark, rows, k=3)
    assert [g[3] for g in got] == [r[3] for r in reach]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(20, [1.0])]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == []


def test_bounds_spare_work_where_vectors_cluster():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 40
    vectors = np.floor(centres[np.arange(4000) % 40] + rng.standard_normal((4000, 16)) * 2)
    ids, pivots = np.arange(4000), T.choose_pivots(vectors[:500])
    table = T.distances(vectors, pivots)
    best = [T.Best(20) for _ in range(50)]
    n = T.search_chunk(best, ids[:50], vectors[:50], table[:50], ids, vectors, table, step=64)
    scores = vectors[:50] @ vectors.T
    for q in range(50):
        scores[q, q] = -np.inf
        order = np.lexsort((ids, -scores[q]))[:20]
        assert order.tolist() == best[q].ids.tolist()
    assert n < 0.6 * 50 * 4000
