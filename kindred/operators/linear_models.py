"""Linear support vector machines of all classes and all folds, trained together.

A pass over the rows gives loss and gradient of every (fold, class) at once: Arrow batches are multiplied with the weights of all models, and a model takes no gradient from the rows of its
own fold. Each task emits one sum, a second step adds them up, so what reaches the driver are 32 buffers of the size of the models. There the models take
quasi-Newton steps, each with a line search of its own; a training of n iterations makes n + 1 passes, whatever the number of classes and folds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.operators.scale_out import broadcast_if_small, running_total

# Executors receive the kernels with the plan and need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

REGULARISATION = 0.01
# Buffers that reach the driver, steps that shape the next one, and classes at most.
BUFFERS, MEMORY, MOST_CLASSES = 32, 8, 10_000
# Rows whose margins by all models are held at once, whatever the size of a batch.
PORTION = 500


def stratified_folds(rows: DataFrame, label: str, folds: int, by: list[str] | None = None, name: str = "fold") -> DataFrame:
    """``rows`` with a fold number: the items of a class are dealt one after another, so its counts in any two folds differ by 1 at most.

    The order is that of ``by``, by default a hash of the id, then the id. Rows of one id and class stay together; a class of any size is numbered by many tasks.
    """
    items = rows.select("id", label).distinct()
    order = by or ["_order", "id"]
    numbered = running_total(items.withColumn("_order", F.xxhash64("id")), [label], order, name="_position")
    dealt = numbered.select(F.col("id").alias("_id"), F.col(label).alias("_label"), ((F.col("_position") - 1) % folds).cast("int").alias(name))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col(label).eqNullSafe(F.col("_label"))
    return rows.join(broadcast_if_small(dealt, computed=True), same).drop("_id", "_label")


@dataclass
class Models:
    """``weights[fold, class]`` and ``bias`` for the vectors as given; the model of a fold never saw its rows."""

    classes: list
    weights: np.ndarray
    bias: np.ndarray
    passes: int = 0


@dataclass
class _Search:
    """Minimises one model: quasi-Newton directions from the last steps, and a step that is halved until the loss falls."""

    x: np.ndarray
    loss: float = np.inf
    slope: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 0.0
    history: list = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.x if self.slope is None else self.x + self.step * self.direction

    def take(self, loss: float, slope: np.ndarray) -> None:
        if self.slope is not None:
            if loss > self.loss + 1e-4 * self.step * (self.slope @ self.direction):
                self.step /= 2
                return
            moved, bent = self.step * self.direction, slope - self.slope
            if moved @ bent > 1e-12:
                self.history = [*self.history[1 - MEMORY :], (moved, bent)]
            self.x = self.x + moved
        self.loss, self.slope, way, kept = loss, slope, -slope, []
        for moved, bent in reversed(self.history):
            kept.append((moved @ way) / (moved @ bent))
            way = way - kept[-1] * bent
        if self.history:
            moved, bent = self.history[-1]
            way = way * (moved @ bent) / (bent @ bent)
        for (moved, bent), a in zip(self.history, reversed(kept)):
            way = way + (a - (bent @ way) / (moved @ bent)) * moved
        self.direction, self.step = way, 1.0 if self.history else min(1.0, 1 / max(float(np.linalg.norm(slope)), 1e-12))


def _portions(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, PORTION):
        part = batch.slice(at, PORTION)
        yield part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim), part["code"].to_numpy(), part["fold"].to_numpy()


def _sums(batches: Iterator[pa.RecordBatch], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Loss, slope by bias and slope by weights of all models, one after another."""
    (folds, classes), dim = b.shape, w.shape[1]
    loss, by_bias, by_weight = np.zeros((folds, classes)), np.zeros((folds, classes)), np.zeros((folds * classes, dim))
    for batch in batches:
        for x, code, fold in _portions(batch, dim):
            side = np.where(code[:, None] == np.arange(classes), 1.0, -1.0)[:, None, :]
            short = np.maximum(0, 1 - side * ((x @ w.T).reshape(-1, folds, classes) + b))
            short *= (fold[:, None] != np.arange(folds))[:, :, None]
            loss += (short * short).sum(axis=0)
            pull = -2 * side * short
            by_bias += pull.sum(axis=0)
            by_weight += pull.reshape(len(x), -1).T @ x
    return np.concatenate([loss.ravel(), by_bias.ravel(), by_weight.ravel()])


def _pass(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the squared hinge losses and of their slopes by weights and bias, over the rows outside a model's fold."""
    folds, classes, dim = weights.shape
    held = rows.sparkSession.sparkContext.broadcast((weights.reshape(-1, dim), bias))
    schema = pa.schema([("part", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _sums(batches, *held.value)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % BUFFERS], pa.int32()), pa.array([sums])], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        sums = np.sum([s.values.to_numpy() for s in table["sums"]], axis=0)
        return pa.table([table["part"][:1], pa.array([sums])], schema=schema)

    kind = from_arrow_schema(schema)
    found = rows.mapInArrow(work, kind).groupBy("part").applyInArrow(add, kind).toArrow()
    held.destroy()
    size = folds * classes
    sums = np.sum([s.values.to_numpy() for s in found["sums"]], axis=0) if found.num_rows else np.zeros(size * (2 + dim))
    return sums[:size].reshape(folds, classes), sums[size : 2 * size].reshape(folds, classes), sums[2 * size :].reshape(folds, classes, dim)


def _coded(rows: DataFrame, feature: str, label: str, fold: str | None, classes: list, dim: int) -> DataFrame:
    """``x, code, fold`` of the rows that can be learnt from or judged."""
    codes = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    chosen = rows.filter((F.size(feature) == dim) & F.col(label).isin(classes)) if classes else rows.filter("false")
    return chosen.select(F.col(feature).alias("x"), codes.alias("code"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))


def train_together(rows: DataFrame, feature: str, label: str, fold: str | None = None, folds: int = 1, iterations: int = 50) -> Models:
    """One model per class, on all rows or, with a column ``fold`` of 0 to ``folds - 1``, for each fold on the rows outside it.

    Vectors are brought to mean 0 and deviation 1 of the rows that a model sees. Rows with a vector of another length than the first, or without a class, are left out.
    """
    if fold is None:
        folds = 1
    classes = sorted(r[0] for r in rows.select(label).distinct().filter(F.col(label).isNotNull()).limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    first = rows.filter(F.size(feature) > 0).select(F.size(feature).alias("n")).first()
    dim = first["n"] if first else 0
    data = _coded(rows, feature, label, fold, classes, dim)
    if not classes or not dim:
        return Models(classes, np.zeros((folds, len(classes), dim)), np.zeros((folds, len(classes))))
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("x"))
    n, total, square = np.zeros(folds + 1), np.zeros((folds + 1, dim)), np.zeros((folds + 1, dim))
    for r in data.groupBy("fold").agg(summary.alias("s")).collect():  # a row per fold
        at = r["fold"] if 0 <= r["fold"] < folds else folds
        count, mean = r["s"]["count"], r["s"]["mean"].toArray()
        n[at] += count
        total[at] += count * mean
        square[at] += r["s"]["variance"].toArray() * max(count - 1, 0) + count * mean**2
    seen = n.sum() - n[:folds] if fold else np.array([n.sum()])
    others = np.maximum(seen, 1)[:, None]
    mean = (total.sum(axis=0) - (total[:folds] if fold else 0)) / others
    spread = np.sqrt(np.maximum((square.sum(axis=0) - (square[:folds] if fold else 0)) / others - mean**2, 0))
    unit = np.where(spread > 1e-12, 1 / np.where(spread > 1e-12, spread, 1), 0.0)
    searches = [[_Search(np.zeros(dim + 1)) for _ in classes] for _ in range(folds)]
    models = Models(classes, np.zeros((folds, len(classes), dim)), np.zeros((folds, len(classes))))

    def plain(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = points[:, :, :dim] * unit[:, None, :]
        return weights, points[:, :, dim] - (weights * mean[:, None, :]).sum(axis=2)

    for _ in range(iterations + 1):
        points = np.array([[s.trial() for s in row] for row in searches])
        loss, by_bias, by_weight = _pass(data, *plain(points))
        models.passes += 1
        slope = (by_weight - by_bias[:, :, None] * mean[:, None, :]) * unit[:, None, :] / others[:, :, None]
        for f, row in enumerate(searches):
            for c, search in enumerate(row):
                w = np.append(points[f, c, :dim], 0.0)
                search.take(loss[f, c] / others[f, 0] + REGULARISATION / 2 * (w @ w), np.append(slope[f, c], by_bias[f, c] / others[f, 0]) + REGULARISATION * w)
    models.weights, models.bias = plain(np.array([[s.x for s in row] for row in searches]))
    return models


def predict_together(models: Models, rows: DataFrame, feature: str, fold: str | None = None, name: str = "predicted") -> DataFrame:
    """``rows`` with the class of the largest margin, by the model of the row's fold; null for vectors of another length."""
    folds, _, dim = models.weights.shape
    held = rows.sparkSession.sparkContext.broadcast((models.weights, models.bias))

    def work(x: pa.Array, fold: pa.Array) -> pa.Array:
        weights, bias = held.value
        sizes = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        numbers = fold.fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.full(len(x), -1)
        for f in range(folds):
            mine = np.flatnonzero((sizes == dim) & (numbers == f))
            if weights.size:
                for at in range(0, len(mine), PORTION):
                    part = mine[at : at + PORTION]
                    values = x.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                    out[part] = (values @ weights[f].T + bias[f]).argmax(axis=1)
        return pa.array(out, pa.int32())

    code = F.arrow_udf(work, "int")(F.col(feature), (F.col(fold) if fold else F.lit(0)).cast("int"))
    kind = rows.sparkSession.createDataFrame([(c,) for c in models.classes]).schema[0].dataType if models.classes else None
    known = F.array(*[F.lit(c).cast(kind) for c in models.classes]) if models.classes else F.array(F.lit(None).cast("int"))
    return rows.withColumn("_code", code).withColumn(name, F.when(F.col("_code") >= 0, F.get(known, F.col("_code")))).drop("_code")


def measures_of(counts: dict[tuple, int]) -> dict[str, float]:
    """Accuracy, and precision, recall and f1 weighted by the true classes, of counts by (true, predicted). Sums are divided once, so without an error all are 1."""
    n = sum(counts.values())
    sums: dict[str, list[float]] = {m: [] for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    for c in {k[0] for k in counts}:
        right = counts.get((c, c), 0)
        true, found = (sum(v for k, v in counts.items() if k[i] == c) for i in (0, 1))
        precision, recall = right / found if found else 0.0, right / true
        sums["accuracy"].append(right)
        sums["weightedPrecision"].append(precision * true)
        sums["weightedRecall"].append(right)
        sums["f1"].append((2 * precision * recall / (precision + recall) if precision + recall else 0.0) * true)
    return {m: fsum(parts) / n if n else 0.0 for m, parts in sums.items()}
