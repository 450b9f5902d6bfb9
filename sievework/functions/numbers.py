"""Numeric and score-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import let


def ratio_or_zero(num: Column, den: Column) -> Column:
    """The classifier convention: nothing over nothing is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def ratio_or_null(num: Column, den: Column) -> Column:
    """The evaluation convention: a score without rows is null."""
    return F.when(den != 0, num / den)


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    shares = lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total))
    return let(powers, shares)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_positions(scores: Column, k: int) -> Column:
    """Positions of the k highest scores, the lower position first among equals."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("at"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["at"])


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")
