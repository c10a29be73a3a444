"""Distances that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    """``sqrt(sum((a-b)^2))`` of two equally long arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def upper_triangle(matrix: Column, dim: Column) -> Column:
    """Row-major upper triangle, diagonal included, of a flattened square matrix."""
    return F.filter(matrix, lambda _, i: (i % dim) >= F.floor(i / dim))


def gaussian_vector(mean: Column, cov: Column) -> Column:
    """Mean followed by the upper triangle of the covariance, as one vector."""
    return F.concat(mean, upper_triangle(cov, F.size(mean)))


def gaussian_euclidean(mean_a: Column, cov_a: Column, mean_b: Column, cov_b: Column) -> Column:
    """Euclidean distance of two Gaussians; each off-diagonal entry counts once."""
    return euclidean(gaussian_vector(mean_a, cov_a), gaussian_vector(mean_b, cov_b))


def edit_distance(a: Column, b: Column, at_most: int | None = None) -> Column:
    """Levenshtein distance; with ``at_most`` larger distances give -1 and cost less."""
    exact = F.levenshtein(a, b) if at_most is None else F.levenshtein(a, b, at_most)
    return exact.cast("double")


def edit_distance_within(a: Column, b: Column, limit: float) -> Column:
    """Levenshtein distance up to ``limit``, else null. Sequences whose lengths differ by more are not compared, of the others only a band of the table is filled."""
    most = int(limit)
    near = F.abs(F.length(a) - F.length(b)) <= most
    return F.when(near, F.nullif(edit_distance(a, b, most), F.lit(-1.0)))
