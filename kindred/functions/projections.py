"""Cells of random projections: one matrix product per Arrow batch.

Planes and offsets follow a rule, so every task, run and engine gives the same cells: the component j of plane i is the first 32 bits of
``md5("seed:i:j")``, spread over -1 to 1, before the plane is brought to length 1; its offset is ``md5("seed:i:offset")``, spread over 0 to 1.
"""

from __future__ import annotations

import hashlib
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# Executors receive the kernels with the plan and need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def _bits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@lru_cache(maxsize=8)
def planes(dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as columns, and offsets; the first ones stay the same when planes are added."""
    values = np.array([[_bits(f"{seed}:{i}:{j}") / 2.0**31 - 1 for j in range(dim)] for i in range(n)]).reshape(n, dim)
    lengths = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return (values / np.where(lengths > 0, lengths, 1)).T.copy(), np.array([_bits(f"{seed}:{i}:offset") / 2.0**32 for i in range(n)])


def _weights(per_table: int, seed: int) -> np.ndarray:
    """A key is a sum over cells, so the neighbours' keys are differences away from it."""
    return np.random.default_rng(seed).integers(-(2**62), 2**62, per_table) * 2 + 1


def buckets(values: np.ndarray, made: tuple[np.ndarray, np.ndarray], width: float, tables: int, per_table: int, seed: int, probe: bool) -> np.ndarray:
    """Of each row of ``values`` the bucket in every table, or with ``probe`` the buckets to ask, ``2 ** per_table`` one after another for each table."""
    weights = _weights(per_table, seed)
    place = values @ made[0] / width + made[1]
    cells = np.floor(place)
    with np.errstate(over="ignore", invalid="ignore"):
        own = (cells.astype(np.int64).reshape(-1, tables, per_table) * weights).sum(axis=2)
        if probe:
            chosen = (np.arange(2**per_table)[:, None] >> np.arange(per_table)) & 1
            aside = np.where(place - cells < 0.5, -1, 1).reshape(-1, tables, per_table) * weights
            own = (own[:, :, None] + aside @ chosen.T).reshape(len(own), tables * 2**per_table)
    return own


def keys(dim: int, width: float, tables: int, per_table: int, seed: int, probe: bool):
    """A UDF of a vector: its bucket in every table, or the buckets to ask there.

    A bucket is named by the cells of ``per_table`` projections. A query asks its own bucket and all that differ from it by the nearer neighbouring cell in
    any projections, ``2 ** per_table`` in each table. Vectors that are missing or of another length give null.
    """
    made = planes(dim, tables * per_table, seed)

    def run(x: pa.Array) -> pa.Array:
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        sizes = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fits = (sizes == dim) & (dim > 0)
        good = np.flatnonzero(fits)
        values = x.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(len(good), dim)
        own = buckets(values, made, width, tables, per_table, seed, probe)
        lengths = np.zeros(len(x), np.int64)
        lengths[good] = own.shape[1]
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(~fits, False))
        return pa.ListArray.from_arrays(ends, pa.array(own.reshape(-1), pa.int64()))

    return F.arrow_udf(run, ArrayType(LongType()))


class Asked:
    """A block of queries that holds items against itself: in how many tables they share a bucket, and which are near.

    Of an item and a query no row is made: what is kept are counts of items by query and shared tables, and the near ones.
    """

    def __init__(self, values: np.ndarray, made: tuple[np.ndarray, np.ndarray], width: float, tables: int, per_table: int, seed: int) -> None:
        self.values, self.settings, self.tables = values, (made, width, tables, per_table, seed), tables
        self.squares = (values * values).sum(axis=1)
        self.levels = np.zeros((len(values), tables + 1), np.int64)
        asked = buckets(values, *self.settings, probe=True).reshape(len(values), tables, -1)
        owner = np.repeat(np.arange(len(values), dtype=np.int32), asked.shape[2])
        self.sorted = []
        for t in range(tables):
            flat = asked[:, t].ravel()
            order = np.argsort(flat, kind="stable")
            self.sorted.append((flat[order], owner[order]))

    def shared(self, items: np.ndarray) -> np.ndarray:
        """Tables shared, by query and item."""
        n, q = len(items), len(self.values)
        stands = buckets(items, *self.settings, probe=False)
        out, met, waiting = np.zeros(q * n, np.uint16), [], 0
        for t, (asked, owner) in enumerate(self.sorted):
            first = np.searchsorted(asked, stands[:, t], "left")
            many = np.searchsorted(asked, stands[:, t], "right") - first
            item = np.repeat(np.arange(n), many)
            at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            met.append(owner[at] * n + item)
            waiting += len(item)
            if waiting >= q * n or t == self.tables - 1:
                out += np.bincount(np.concatenate(met), minlength=q * n).astype(np.uint16)
                met, waiting = [], 0
        return out.reshape(q, n)

    def take(self, items: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts the items; queries, items and shared tables of those that share one and are closer than ``threshold``, give or take round-off."""
        shared = self.shared(items)
        width = self.tables + 1
        self.levels += np.bincount((np.arange(len(shared))[:, None] * width + shared).ravel(), minlength=self.levels.size).reshape(-1, width)
        near = shared > 0
        if threshold < np.inf:
            size = self.squares[:, None] + (items * items).sum(axis=1)
            near &= size - 2 * (self.values @ items.T) < threshold * threshold + 1e-9 * (size + threshold * threshold)
        query, item = np.nonzero(near)
        return query, item, shared[query, item]
