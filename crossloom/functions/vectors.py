"""Column functions on ``array<float|double>`` vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossloom import constants as C


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors give 0 because of the small number in the norms."""
    return dot(a, b) / ((norm(a) + C.NORM_EPSILON) * (norm(b) + C.NORM_EPSILON))


def pair_similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity of two given vectors; distances come with a minus sign so that large is near."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "l2_rows":
        a, b = unit(a), unit(b)
    elif metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    return -F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def blend(a: Column, b: Column, share: Column) -> Column:
    """``(1 - share) * a + share * b``."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * (1 - share) + y * share)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def vector_stats(a: Column) -> Column:
    """``struct(mean, std, max, min, l2_norm)``; std is the population form."""
    d = doubles(a)
    mean = _sum(d) / F.size(d)
    var = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(d) - mean * mean
    return F.struct(
        mean.alias("mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
        F.array_max(d).alias("max"),
        F.array_min(d).alias("min"),
        norm(a).alias("l2_norm"),
    )
