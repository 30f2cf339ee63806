"""The error statistics as aggregate expressions. NaN counts as missing; a small group gives NULL where a statistic needs more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def mae(x: Column) -> Column:
    return F.avg(F.abs(x))


def skew(x: Column) -> Column:
    """Skewness, corrected for bias; from three values on."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / F.when(n > 2, n - 2))


def kurtosis(x: Column) -> Column:
    """Excess kurtosis, corrected for bias; from four values on."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def quantile(x: Column, p: float) -> Column:
    """Exact quantile, interpolated between neighbours."""
    return F.percentile(x, F.lit(p))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of rows that have both; NULL for a constant or a single pair, where Spark's own would raise."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
