"""Exact top-k inner products by pivot-table elimination.

Every vector gets its distances to a set of pivots once, in a written table. For a query q, a vector v and any
pivot p, ``|q - v| >= |d(q, p) - d(v, p)|``; the largest of these lower bounds gives an upper bound of the inner product,
``q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2``. Candidates are evaluated in the order of that bound until the
next bound is below the k-th best score found: what follows cannot be in the answer, so the result is exact. A small
sample gives every query a first score to beat.

Queries are a stated set, held against all rows in blocks: a block of at most ``BLOCK_BYTES`` is broadcast, each
task of the pivot table keeps k rows per query, and the partial answers are merged by an aggregate per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm.common import materialise, via_arrow

PIVOTS = 16
SAMPLE = 2048
BLOCK_BYTES = 8 << 20
STEP = 256
LONG = 2**63 - 1


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``id`` and ``floor(scale * x)`` per component; vectors that are null, empty of an id, or hold a null or
    non-finite component are left out."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.filter(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id).cast("long").alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Values and offsets of a list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets, len(column)


def by_dimension(ids: np.ndarray, column: pa.Array):
    """(dimension, ids, matrix) for each length of vector in the batch."""
    values, offsets, _ = _matrix(column)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), ids[rows], values[offsets[rows][:, None] + np.arange(dim)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample that lie far from each other, chosen one after another."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; whole-number doubles are exact below 2^53, larger ones take Python's integers."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    out = whole(a).dot(whole(b).T)
    return np.array([[min(max(x, -LONG - 1), LONG) for x in row] for row in out], dtype=np.int64)


class Best:
    """The k best ids (score, smaller id first) of one query, as far as they are known; an id has one place, with its best score."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def limit(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores)) if scores.min(initial=0) > -LONG else np.array(
            sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i]))), dtype=int
        )
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])[: self.k]]
        self.scores, self.ids = scores[order], ids[order]


def search_chunk(
    best: list[Best], query_ids: np.ndarray, queries: np.ndarray, query_table: np.ndarray, ids: np.ndarray,
    vectors: np.ndarray, table: np.ndarray, floor: np.ndarray | None = None, step: int = STEP,
) -> int:
    """Hold every query against a chunk of vectors; returns how many inner products were computed.

    ``floor`` has for every query a score that its k-th best is known to reach.
    """
    query_norms, norms = (queries * queries).sum(1), (vectors * vectors).sum(1)
    # Single precision is enough for bounds while squares stay far inside its range; the slack covers its rounding.
    kind = np.float32 if max(norms.max(initial=0), query_norms.max(initial=0)) < 1e12 else np.float64
    rounding = 1e-5 if kind is np.float32 else 1e-9
    table, query_table = np.ascontiguousarray(table.T, dtype=kind), query_table.astype(kind)
    base = ((norms / 2) * (1 + 2 * rounding) + 1e-3).astype(kind)
    evaluated, n = 0, len(vectors)
    reach = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, vectors.shape[1])
    if reach < 2**24:  # whole numbers of this size are exact in single precision, too
        vectors, queries = vectors.astype(np.float32), queries.astype(np.float32)
    for q in range(len(queries)):
        lower = np.zeros(n, kind)
        for p in range(len(table)):
            gap = table[p] - query_table[q, p]
            np.maximum(lower, np.abs(gap, out=gap), out=lower)
        upper = base - lower * lower / 2 + kind(query_norms[q] / 2 * (1 + 2 * rounding))
        limit = best[q].limit() if floor is None else max(best[q].limit(), floor[q])
        open_, size = np.flatnonzero(upper >= limit), step
        # Bound order, in growing steps: the most promising ones first, the rest as far as it is still open after them.
        while len(open_):
            if len(open_) > size:
                cut = np.argpartition(-upper[open_], size - 1)
                part, open_ = open_[cut[:size]], open_[cut[size:]]
            else:
                part, open_ = open_, open_[:0]
            evaluated += len(part)
            if reach >= 2**53:
                scores = inner(queries[q : q + 1], vectors[part])[0]
            elif 2 * len(part) > n:  # reading all rows in their order is cheaper than gathering most of them
                scores = (vectors @ queries[q])[part]
            else:
                scores = vectors[part] @ queries[q]
            good = (scores >= limit) & (ids[part] != query_ids[q])
            if good.any():
                best[q].add(scores[good].astype(np.int64), ids[part[good]])
                limit = max(limit, best[q].limit())
            open_, size = open_[upper[open_] >= limit], 16 * size
    return evaluated


Sample = dict[int, tuple[np.ndarray, np.ndarray]]


def sample_of(vectors: DataFrame, size: int = SAMPLE) -> Sample:
    """Ids and vectors, by dimension, of the ``size`` rows with the smallest hash of their id."""
    rows = vectors.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    if not rows.num_rows:
        return {}
    return {dim: (ids, m) for dim, ids, m in by_dimension(rows["vec_id"].to_numpy(), rows["v"].combine_chunks())}


def pivot_table(vectors: DataFrame, sample: Sample, n: int = PIVOTS) -> DataFrame:
    """``vectors`` with the distances ``d`` to ``n`` pivots of their dimension, taken from ``sample``; written once."""
    pivots = {dim: choose_pivots(found, n) for dim, (_, found) in sample.items()}
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("d", pa.list_(pa.float64()))])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = np.asarray(batch["vec_id"])
        found: dict[int, list[float]] = {}
        for dim, part, matrix in by_dimension(np.arange(len(ids)), batch["v"]):
            table = distances(matrix, pivots[dim]) if dim in pivots else np.zeros((len(part), 0))
            found.update(zip(part.tolist(), table.tolist(), strict=True))
        lists = pa.array([found[i] for i in range(len(ids))], pa.list_(pa.float64()))
        return pa.record_batch([batch["vec_id"], batch["v"], lists], schema=schema)

    return materialise(via_arrow(vectors, measure, schema), "pivots")


def floors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Scores that the k-th best of each query reaches at least: its k-th best among a few vectors."""
    if len(ids) <= k:
        return np.full(len(queries), -np.inf)
    scores = inner(queries, sample).astype(float)
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k]


def _partial(block: list[tuple], k: int):
    """A task's work: the k best rows of its vectors for every query of the block."""

    def run(batches):
        best: dict[int, list[Best]] = {}
        for dim, ids, _, _, _ in block:
            best[dim] = [Best(k) for _ in ids]
        for batch in batches:
            all_ids = np.asarray(batch["vec_id"])
            rows = np.arange(len(all_ids))
            tables = {dim: (part, m) for dim, part, m in by_dimension(rows, batch["v"])}
            for dim, query_ids, queries, query_table, floor in block:
                if dim not in tables:
                    continue
                part, vectors = tables[dim]
                found, offsets, _ = _matrix(batch["d"])
                table = found[offsets[part][:, None] + np.arange(query_table.shape[1])]
                search_chunk(best[dim], query_ids, queries, query_table, all_ids[part], vectors, table, floor)
        for dim, query_ids, _, _, _ in block:
            kept = [(q, b) for q, b in zip(query_ids.tolist(), best[dim], strict=True) if len(b.ids)]
            if kept:
                yield pa.record_batch(
                    [
                        pa.array(np.repeat([q for q, _ in kept], [len(b.ids) for _, b in kept]), pa.int64()),
                        pa.array(np.concatenate([b.ids for _, b in kept]), pa.int64()),
                        pa.array(np.concatenate([b.scores for _, b in kept]), pa.int64()),
                    ],
                    schema=PAIRS,
                )

    return run


PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, is_query, k: int = 20, n_pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of every query with all other vectors.

    ``vectors`` has ``vec_id`` and whole-number ``v`` (see ``quantised``); ``is_query`` is a condition on it. Equal
    scores go to the smaller id. Vectors of another length than the query's are no candidates. Rows that repeat an id
    and a vector count once; an id with several vectors keeps one row per pair, the best. Scores beyond a long are held at its ends.
    An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.dropDuplicates(["vec_id", "v"])
    sample = sample_of(vectors)
    stored = pivot_table(vectors, sample, n_pivots)
    queries = stored.filter(is_query)
    dim = max(1, (queries.agg(F.max(F.size("v") + F.size("d")).alias("n")).first()["n"] or 1))
    per_block = max(1, block_bytes // (8 * dim))
    n_blocks = max(1, -(-queries.count() // per_block))
    block_of = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks))
    partial = None
    for b in range(n_blocks):
        # One block at a time is in the driver; it holds about per_block queries, whatever the table's size.
        rows = queries.filter(block_of == b).toArrow()
        if not rows.num_rows:
            continue
        query_ids, lists, d = rows["vec_id"].to_numpy(), rows["v"].combine_chunks(), rows["d"].combine_chunks()
        block = []
        for length, part, matrix in by_dimension(np.arange(len(query_ids)), lists):
            found, offsets, _ = _matrix(d)
            width = int(offsets[part[0] + 1] - offsets[part[0]])
            ids, near = sample.get(length, (np.empty(0, np.int64), np.empty((0, length))))
            low = floors(query_ids[part], matrix, ids, near, k)
            block.append((length, query_ids[part], matrix, found[offsets[part][:, None] + np.arange(width)], low))
        held = spark.sparkContext.broadcast(block)
        run = (lambda held: lambda batches: _partial(held.value, k)(batches))(held)
        found = materialise(stored.mapInArrow(run, from_arrow_schema(PAIRS)), "topk")
        partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = spark.createDataFrame([], from_arrow_schema(PAIRS))
    once = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
