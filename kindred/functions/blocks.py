"""Arrow kernels that hold an item against a whole block of queries, so that its arrays go to Python once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Executors receive the kernels with the plan and need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def against(kernel: Callable, queries, columns: Sequence[str]):
    """A UDF of the item's features: one value per row of the broadcast table ``queries``, in its order.

    ``kernel`` takes the item's and the query's features as Arrow arrays and gives distances, or structs that start with one.
    """

    def run(*items: pa.Array) -> pa.Array:
        table, n = queries.value, len(items[0])
        sides = [table[c].combine_chunks() for c in columns]
        values, known = np.zeros((n, table.num_rows)), np.zeros((n, table.num_rows), bool)
        for q in range(table.num_rows):
            repeated = pa.array(np.full(n, q))
            out = kernel(*items, *[s.take(repeated) for s in sides])
            out = out.field(0) if pa.types.is_struct(out.type) else out
            values[:, q], known[:, q] = out.fill_null(0.0).to_numpy(), out.is_valid().to_numpy(zero_copy_only=False)
        flat = pa.array(values.reshape(-1), mask=~known.reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * table.num_rows), flat)

    return F.arrow_udf(run, ArrayType(DoubleType()))
