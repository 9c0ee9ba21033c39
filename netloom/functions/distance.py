"""Distances between array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "minkowski", "chebyshev", "cosine")


def check_metric(metric: str, p: float = 2.0) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    if metric == "minkowski" and p < 1:
        raise ValueError("minkowski needs p >= 1")


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance between two ``ARRAY<DOUBLE>`` columns of equal length."""
    check_metric(metric, p)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    if metric == "cosine":
        dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "manhattan":
        return total(parts)
    if metric == "chebyshev":
        return F.array_max(parts)
    return F.pow(total(F.transform(parts, lambda v: F.pow(v, F.lit(float(p))))), F.lit(1.0 / p))
