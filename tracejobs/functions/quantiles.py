"""Quantiles and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(values: Column, q: float) -> Column:
    """The nearest-rank quantile of a sorted array: the element at round(q * (n - 1)), half away from zero."""
    return F.get(values, F.round(F.lit(q) * (F.size(values) - 1)).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def relative_diff(a: Column, b: Column) -> Column:
    """(b - a) / a; from 0 it is 1 unless b is 0 too."""
    return F.when(a == 0, F.when(b == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(b - a, a))
