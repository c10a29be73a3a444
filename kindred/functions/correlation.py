"""Cross-correlation of 12-line pitch matrices, one Arrow batch at a time.

A full two-dimensional correlation has one line per pitch shift -11..11 (line ``shift + 11``) and
one entry per time lag. Every variant below picks lines and lags of that one result, computed by
FFT along time. Larger values mean more similar.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors receive the kernels with the plan and need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

# Pitch classes per octave and the first-order 0.1 Nyquist high-pass filter.
PITCHES = 12
FEEDBACK = 0.7265425280
GAIN = 0.8632712640

# Cells transformed at once: a few dozen long matrices, which stay in the processor cache.
CELLS = 200_000


def _high_pass(lines: list[np.ndarray]) -> np.ndarray:
    """Maximum of each filtered line; all lines of the batch advance together in time."""
    length = max(map(len, lines))
    padded = np.zeros((length + 1, len(lines)))
    for i, line in enumerate(lines):
        padded[1 : len(line) + 1, i] = line
    steps = GAIN * np.diff(padded, axis=0)
    for t in range(1, length):
        steps[t] += FEEDBACK * steps[t - 1]
    ends = np.arange(length)[:, None] < np.array([len(x) for x in lines])
    return np.where(ends, steps, -np.inf).max(axis=0)


def _spectra(matrices: list[np.ndarray], n: int) -> np.ndarray:
    """Transforms along time; a matrix object that occurs repeatedly is transformed once."""
    distinct = {id(m): m for m in matrices}
    padded = np.zeros((len(distinct), PITCHES, n))
    for i, m in enumerate(distinct.values()):
        padded[i, :, : m.shape[1]] = m
    place = {key: i for i, key in enumerate(distinct)}
    return np.fft.rfft(padded)[[place[id(m)] for m in matrices]]


def _lines(pairs: list[tuple[np.ndarray, np.ndarray]], shifts: range) -> list[np.ndarray]:
    """Full correlations along time, one array ``(shift, lag)`` per pair ``(fixed, moved)``.

    Pairs with the same FFT length are transformed together, a bounded number at a time.
    """
    out: list = [None] * len(pairs)
    sizes = np.array([a.shape[1] + v.shape[1] - 1 for a, v in pairs])
    lengths = 1 << np.ceil(np.log2(sizes)).astype(int)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, CELLS // (PITCHES * len(shifts) * int(n)))
        for chunk in np.array_split(rows, -(-len(rows) // step)):
            fixed = _spectra([pairs[i][0] for i in chunk], n)
            moved = np.conj(_spectra([pairs[i][1] for i in chunk], n))
            lines = np.empty((len(chunk), len(shifts), n))
            for k, s in enumerate(shifts):
                low, high = max(0, -s), min(PITCHES, PITCHES - s)
                lines[:, k] = np.fft.irfft((fixed[:, low + s : high + s] * moved[:, low:high]).sum(axis=1), n)
            for i, line in zip(chunk, lines):
                # negative lags sit at the end of the transform
                before = pairs[i][1].shape[1] - 1
                out[i] = np.concatenate([line[:, n - before :], line[:, : sizes[i] - before]], axis=1)
    return out


def _matrices(column: pa.Array, time_major: bool) -> list[np.ndarray | None]:
    """One 12-line view per row; ``None`` for null, empty or a length that twelve lines do not share, the same object for
    a repeated row.

    Either the query or the item repeats in neighbouring pairs.
    """
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out, last = [], None
    for flat in np.split(values, ends[:-1]):
        if last is not None and len(flat) and np.array_equal(flat, last):
            out.append(out[-1])
            continue
        last = flat if len(flat) and not len(flat) % PITCHES else None
        if last is None:
            out.append(None)
            continue
        shaped = flat.reshape(-1, PITCHES).T if time_major else flat.reshape(PITCHES, -1)
        out.append(shaped)
    return out


def _variant(line=0, same=None, time_major=False, longest_first=True, clear_offset=False, filtered=False,
             per_length=False):
    """Build one batch function.

    ``line``: a pitch shift, ``"all"`` for the maximum over lines, ``"peak"`` for the line holding it.
    ``same``: first kept lag as a function of the shorter length; ``None`` keeps the full result.
    """
    if isinstance(line, int):
        shifts = range(line, line + 1)
    elif same is None:
        shifts = range(1 - PITCHES, PITCHES)
    else:
        # "same" along the pitch axis keeps shifts -5..6
        shifts = range(PITCHES // 2 - PITCHES + 1, PITCHES // 2 + 1)

    def ordered(a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (v, a) if longest_first and a.shape[1] <= v.shape[1] else (a, v)

    def kept(full: np.ndarray, m: int, n: int) -> np.ndarray:
        if same is not None:
            full = full[:, same(n) : same(n) + m]
        chosen = full[np.unravel_index(full.argmax(), full.shape)[0]]
        if clear_offset:
            chosen = chosen - chosen[0]
        return chosen / n if per_length else chosen

    def run(item: pa.Array, query: pa.Array) -> pa.Array:
        sides = list(zip(_matrices(item, time_major), _matrices(query, time_major)))
        present = np.array([a is not None and v is not None for a, v in sides], bool)
        pairs = [ordered(a, v) for (a, v), here in zip(sides, present) if here]
        values = np.full(len(sides), np.nan)
        if pairs:
            lines = [kept(full, a.shape[1], v.shape[1]) for full, (a, v) in zip(_lines(pairs, shifts), pairs)]
            values[present] = _high_pass(lines) if filtered else [x.max() for x in lines]
        return pa.array(values, mask=~present)

    return F.arrow_udf(run, DoubleType())


def _numpy_same(n: int) -> int:
    return (n - 1) // 2


def _image_same(n: int) -> int:
    return n // 2


# The correlation the full query uses: no pitch shift, offset removed, high-pass, maximum.
chroma_correlation = _variant(same=_numpy_same, clear_offset=True, filtered=True)
correlation_maximum_same = _variant(line="all", same=_image_same)
correlation_peak_line = _variant(line="peak", time_major=True, filtered=True)
correlation_fixed_line = _variant(line=1, time_major=True, longest_first=False)
correlation_maximum_full = _variant(line="all", time_major=True, longest_first=False)
correlation_per_length = _variant(line=1, same=_image_same, time_major=True, per_length=True)
correlation_unshifted = _variant(same=_image_same, clear_offset=True, filtered=True)
