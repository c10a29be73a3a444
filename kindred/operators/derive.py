"""Track-level features from frame-level rows.

A frame is one row ``(track, <order columns>, values array, is_beat)``. A beat ends the interval
before it, so the interval of a frame is the number of beats up to and including the frame, and
frames from the last beat on belong to no complete interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.scale_out import exact_median, running_total

# The twelve pitch classes, A first, and the flat spellings of five of them.
PITCHES = ("A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#")
FLATS = {"Ab": "G#", "Gb": "F#", "Eb": "D#", "Db": "C#", "Bb": "A#"}
# Share of the mean frame sum below which a frame is silent, and the share of the
# maximum below which a bin is.
SILENCE = 0.5
QUIET_BIN = 0.8


def key_index(key: Column) -> Column:
    """0 for A to 11 for G#."""
    sharp = key
    for flat, same in FLATS.items():
        sharp = F.when(key == flat, F.lit(same)).otherwise(sharp)
    return F.array_position(F.array(*[F.lit(p) for p in PITCHES]), sharp).cast("int") - 1


def to_common_key(bin_: Column, key: Column) -> Column:
    """Bin or note number relative to the key."""
    return (bin_ + 12 - key_index(key)) % 12


def transpose_notes(notes: Column, key: Column) -> Column:
    return F.transform(notes, lambda n: to_common_key(n, key))


def with_intervals(frames: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``interval`` and ``complete`` to every frame, and with ``values`` the loudness below which a frame of the track is silent.

    A hot track is spread over partitions."""
    beat = F.col("is_beat").cast("int")
    sums = {"_beats": beat, "_loudness": _total(F.col("values")), "_frames": F.lit(1)} if "values" in frames.columns else {"_beats": beat}
    counted = running_total(frames, ["track"], order_by, beat, "interval", sums)
    silence = {"silence": F.col("_loudness") / F.col("_frames") * SILENCE} if "values" in frames.columns else {}
    return counted.withColumns({"complete": F.col("interval") < F.col("_beats"), **silence}).drop(*sums)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _summed(rows: DataFrame, by: Sequence[str], values: Column, bins: int, f=F.sum) -> DataFrame:
    """Per-bin aggregate of an array column, with map-side combine."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_frames"), *[f(values[b]).alias(f"_{b}") for b in range(bins)]).select(
        *by, "n_frames", F.array(*[F.col(f"_{b}") for b in range(bins)]).alias("values")
    )


def beat_averages(intervals: DataFrame, bins: int) -> DataFrame:
    """Mean frame of every complete interval, divided by its sum of absolute values unless all are zero."""
    means = _summed(intervals.filter("complete"), ["track", "interval"], F.col("values"), bins, F.avg)
    norm = _total(F.transform("values", F.abs))
    unit = F.transform("values", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
    return means.select("track", "interval", unit.alias("values"))


def _peaks(values: Column) -> Column:
    top = F.array_max(values)
    return F.transform(values, lambda x: F.when(x == top, 1.0).when(x < QUIET_BIN, 0.0).otherwise(x))


def dominant_bins(intervals: DataFrame, bins: int, averaged: bool = False) -> DataFrame:
    """Loudest bin of every complete interval, lowest first; 0 for a silent one.

    With ``averaged`` every frame of an interval counts as the mean of the interval.
    """
    rows = intervals.filter("complete")
    if averaged:
        rows = _summed(rows, ["track", "interval", "silence"], F.col("values"), bins, F.avg).drop("n_frames")
    heard = rows.withColumn(
        "values",
        F.when(_total(F.col("values")) > F.col("silence"), _peaks(F.col("values"))).otherwise(
            F.transform("values", lambda _: F.lit(0.0))
        ),
    )
    sums = _summed(heard, ["track", "interval"], F.col("values"), bins)
    return sums.select(
        "track", "interval", (F.array_position("values", F.array_max("values")) - 1).cast("int").alias("note")
    )


def gaussian_summary(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, population variance and upper triangle of the sample covariance, as three arrays."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    return rows.groupBy(*by).agg(
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.var_pop(c) for c in columns]).alias("var"),
        F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).alias("cov"),
    )


def seven_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, variance, skewness, kurtosis, median, minimum, maximum; what is undefined becomes 0."""

    def defined(c: Column) -> Column:
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))

    x = F.col(value)
    moments = rows.groupBy(*by).agg(
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("var"),
        defined(F.skewness(x)).alias("skew"),
        defined(F.kurtosis(x) + 3).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return moments.join(exact_median(rows, by, value), list(by))


def positions(rows: DataFrame, by: Sequence[str], feature: str) -> DataFrame:
    """One row per position of a vector: the long form the segment statistics work on."""
    return rows.select(*by, F.posexplode(feature).alias("pos", "value"))


def segments_to_track(rows: DataFrame, by: Sequence[str], feature: str, how: str = "median") -> DataFrame:
    """Median or mean of the segment vectors of a track, per position."""
    long = positions(rows, by, feature)
    keys = [*by, "pos"]
    if how == "median":
        return exact_median(long, keys, "value", "value")
    return long.groupBy(*keys).agg(F.avg("value").alias("value"))


def temporal_statistics(rows: DataFrame, by: Sequence[str], feature: str) -> DataFrame:
    """The seven statistics of every position over the segments of a track."""
    return seven_statistics(positions(rows, by, feature), [*by, "pos"], "value")


def rhythm_histogram(pattern: Column, bands: int, bins: int) -> Column:
    """Sum of absolute values over the bands per modulation bin; the pattern is stored bin by bin."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: _total(F.transform(F.slice(pattern, b * bands + 1, F.lit(bands)), F.abs)),
    )


def band_sums(rows: DataFrame, by: Sequence[str], axis: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Sum per irregular band ``edges[b] <= axis < edges[b + 1]``; what lies outside is dropped."""
    limits = F.array(*[F.lit(float(e)) for e in edges])
    band = F.size(F.filter(limits, lambda e: e <= F.col(axis))) - 1
    placed = rows.withColumn("band", band).filter((F.col("band") >= 0) & (F.col("band") < len(edges) - 1))
    return placed.groupBy(*by, "band").agg(F.sum(value).alias("total"))
