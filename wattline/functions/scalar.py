"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPE_EPSILON = 1e-8


def safe_double(c: Column, default: float | None = None) -> Column:
    """Double or ``default`` when the text is not a finite number."""
    value = c.try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)  # a NaN is over every number
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip(c: Column, lower: float | Column | None = 0.0, upper: float | Column | None = None) -> Column:
    """Bound a value on either side; a null stays null."""
    out = c
    for bound, pick in ((lower, F.greatest), (upper, F.least)):
        if bound is not None:
            out = pick(out, bound if isinstance(bound, Column) else F.lit(float(bound)))
    return F.when(c.isNotNull(), out)


def rmse(actual: str, predicted: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)))


def mae(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def mape(actual: str, predicted: str) -> Column:
    error = (F.col(actual) - F.col(predicted)) / (F.abs(F.col(actual)) + F.lit(MAPE_EPSILON))
    return F.avg(F.abs(error)) * 100
