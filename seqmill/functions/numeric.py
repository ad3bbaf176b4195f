"""Column functions for probabilities on a log scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def d_logistic(x: Column) -> Column:
    """Derivative of logistic, without overflow for large x."""
    return logistic(x) * logistic(-x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logsumexp(columns: list[Column]) -> Column:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(c - top) for c in columns]))


def log_softmax(columns: list[Column]) -> list[Column]:
    total = logsumexp(columns)
    return [c - total for c in columns]


def rounded(x: Column, places: int) -> Column:
    """x rounded half away from 0, with the sign of x also where that gives 0."""
    return F.when(x < 0, -F.round(-x, places)).otherwise(F.round(x, places))


def scientific(x: Column) -> Column:
    """Nine significant digits, as 1.23456789e-01."""
    return F.format_string("%.8e", x)
