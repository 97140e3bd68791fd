"""Vector expressions on array columns: distances, norms, confidence.

All are compositions of built-in higher-order functions and stay in the JVM.
Vectors are arrays of doubles; ``checked`` guards equal lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Distance at which confidence has fallen to 1/e, by metric (fixed values).
SCALES = {"euclidean": 5000.0, "cosine": 0.5, "manhattan": 10000.0, "chi_square": 1.0, "mahalanobis": 5000.0}


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chi_square(a: Column, b: Column) -> Column:
    """Sum of (a-b)^2 / (a+b) over the components whose sum is positive."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / size)


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


#: Metric name to expression; the covariance metric is declared but falls back to the Euclidean one.
METRICS = {"euclidean": euclidean, "cosine": cosine, "manhattan": manhattan, "chi_square": chi_square, "mahalanobis": euclidean}


def distance(metric: str, a: Column, b: Column) -> Column:
    return METRICS[metric](a, b)


def normalize(v: Column) -> Column:
    """Scaled to length 1; an all-zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(float(by)))


def checked(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error if a vector is null or the lengths differ."""
    same = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors must have the same dimension")).cast("double"))


def compatible(a: Column, algorithm_a: Column, b: Column, algorithm_b: Column) -> Column:
    return F.coalesce((F.size(a) == F.size(b)) & (algorithm_a == algorithm_b), F.lit(False))


def confidence(d: Column, metric: str = "euclidean", by: float | None = None) -> Column:
    return F.exp(-d / F.lit(float(by or SCALES.get(metric, 5000.0))))


def distance_limit(threshold: float, metric: str, by: float | None = None) -> float:
    """The distance up to which the confidence reaches a threshold in (0, 1]."""
    import math

    return -(by or SCALES[metric]) * math.log(threshold)
