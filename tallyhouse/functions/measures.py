"""Aggregate expressions: totals, shares, correlation, error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, name: str) -> Column:
    """A cell, or NULL if it is missing: NULL, and NaN in a column of floating numbers."""
    value = F.col(f"`{name}`")
    return F.when(~F.isnan(value), value) if dict(df.dtypes)[name] in ("double", "float") else value


def total(col: str | Column) -> Column:
    """Sum as double; a group with only missing values sums to 0."""
    return F.coalesce(F.sum(col).cast("double"), F.lit(0.0))


def mean(col: str | Column) -> Column:
    """Mean of the values present, as one division of the exact total by their count.

    Unlike ``avg`` over doubles it does not depend on the order rows are summed in
    when the column is a decimal.
    """
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL for a zero whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pearson(left: Column, right: Column) -> Column:
    """Correlation over rows that have both values; NULL when a side is constant.

    ``corr`` raises a division error on a constant column in ANSI mode, and the test
    for one is made on min and max, which are exact, rather than on the variance.
    """
    x = F.when(right.isNotNull(), left.cast("double"))
    y = F.when(left.isNotNull(), right.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(varies, F.try_divide(F.covar_samp(x, y), spread))
