"""Expressions over feature arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(features: Column, width: int) -> Column:
    """Fit an array to ``width``: zero-padded or cut at the end."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.slice(F.concat(features.cast("array<double>"), zeros), 1, width)


def squared_error(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def mean_squared_error(x: Column, y: Column) -> Column:
    """Reconstruction error of one row."""
    return F.try_divide(squared_error(x, y), F.size(x).cast("double"))


def interpolate(x: Column, y: Column, gap: Column) -> Column:
    """The point ``gap`` of the way from x to y."""
    return F.zip_with(x, y, lambda a, b: a + gap * (b - a))


def linear_score(columns: list[Column], weights: list[float], bias: float) -> Column:
    """Logistic score of a fitted linear model as one expression."""
    margin = reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)], F.lit(float(bias)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
