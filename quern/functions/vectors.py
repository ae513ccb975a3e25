"""Vector arithmetic as Column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(doubles(a), lambda x: F.when(n == 0, x).otherwise(x / n))


def is_valid(v: Column) -> Column:
    """Neither null nor empty, and all numbers finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(doubles(v), finite)


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """W v + b for a small matrix."""
    rows = [dot(F.array(*map(F.lit, row)), v) + F.lit(b) for row, b in zip(weights, bias or [0.0] * len(weights), strict=True)]
    return F.array(*rows)
