"""Divergences of Gaussians, one Arrow batch at a time.

Both return ``struct<distance, status>``. The status takes the place of driver-side counters:
``ok``, ``negative`` (clipped to 0), ``nan`` or ``not_positive_definite`` (both infinite).
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

# Executors receive the kernels with the plan and need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

RESULT = StructType().add("distance", DoubleType()).add("status", StringType())
ARROW_RESULT = pa.struct([("distance", pa.float64()), ("status", pa.string())])


def _cholesky(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors and a success flag per matrix; halves the batch around the bad ones."""
    try:
        return np.linalg.cholesky(matrices), np.ones(len(matrices), bool)
    except np.linalg.LinAlgError:
        if len(matrices) == 1:
            return np.broadcast_to(np.eye(matrices.shape[1]), matrices.shape), np.zeros(1, bool)
    half = len(matrices) // 2
    left, right = _cholesky(matrices[:half]), _cholesky(matrices[half:])
    return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


def _log_det(factors: np.ndarray) -> np.ndarray:
    return 2.0 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)


def _kullback_leibler(m1, s1, m2, s2):
    f1, ok1 = _cholesky(s1)
    f2, ok2 = _cholesky(s2)
    inv1, inv2 = (np.linalg.inv(f) for f in (f1, f2))
    inv1, inv2 = (np.swapaxes(i, 1, 2) @ i for i in (inv1, inv2))
    gap = m1 - m2
    traces = np.einsum("nij,nji->n", s1, inv2) + np.einsum("nij,nji->n", s2, inv1)
    return 0.25 * (traces + np.einsum("ni,nij,nj->n", gap, inv1 + inv2, gap) - 2 * m1.shape[1]), ok1 & ok2


def _jensen_shannon(m1, s1, m2, s2):
    f1, ok1 = _cholesky(s1)
    f2, ok2 = _cholesky(s2)
    outer = [np.einsum("ni,nj->nij", m, m) for m in (m1, m2, 0.5 * m1 + 0.5 * m2)]
    mixed, ok3 = _cholesky(0.5 * (s1 + outer[0]) + 0.5 * (s2 + outer[1]) - outer[2])
    return 0.5 * _log_det(mixed) - 0.25 * _log_det(f1) - 0.25 * _log_det(f2), ok1 & ok2 & ok3


def _rows(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _batched(kernel: Callable):
    def run(mean_a: pa.Array, cov_a: pa.Array, mean_b: pa.Array, cov_b: pa.Array) -> pa.Array:
        columns = (mean_a, cov_a, mean_b, cov_b)
        lengths = np.stack([pc.fill_null(pc.list_value_length(c), -1).to_numpy() for c in columns])
        dims = lengths[0]
        fits = (dims > 0) & (lengths[2] == dims) & (lengths[1] == dims**2) & (lengths[3] == dims**2)
        value = np.full(len(dims), np.nan)
        status = np.full(len(dims), None, object)
        for dim in np.unique(dims[fits]):
            rows = np.flatnonzero(fits & (dims == dim))
            m1, s1, m2, s2 = (_rows(c, rows) for c in columns)
            with np.errstate(all="ignore"):
                raw, definite = kernel(m1, s1.reshape(-1, dim, dim), m2, s2.reshape(-1, dim, dim))
            bad = np.isnan(raw)
            value[rows] = np.where(definite & ~bad, np.maximum(raw, 0.0), np.inf)
            status[rows] = np.select(
                [~definite, bad, raw <= 0], ["not_positive_definite", "nan", "negative"], "ok"
            )
        distance = pa.array(value, mask=~fits)
        return pa.StructArray.from_arrays(
            [distance, pa.array(status, pa.string())], fields=list(ARROW_RESULT), mask=pa.array(~fits)
        )

    return run


# The distance is filtered and scaled after a materialised cut, so each pair is evaluated once.
symmetric_kullback_leibler = F.arrow_udf(_batched(_kullback_leibler), RESULT)
jensen_shannon = F.arrow_udf(_batched(_jensen_shannon), RESULT)
