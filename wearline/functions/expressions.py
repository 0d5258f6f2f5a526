"""Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """A number that is neither null nor NaN nor infinite."""
    x = col(c).try_cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def or_null(c: Column | str) -> Column:
    """The value if it is finite."""
    return F.when(finite(c), col(c))


def clipped(c: Column | str, low: float = 0.0) -> Column:
    return F.greatest(col(c), F.lit(low))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def unbiased_skewness(skew: Column, n: Column) -> Column:
    """From the population skewness; null below 3 values."""
    n = n.cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * skew)


def unbiased_kurtosis(excess: Column, n: Column, fisher: bool = False) -> Column:
    """From the population excess kurtosis; null below 4 values; plus 3 unless fisher."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6) + (0 if fisher else 3))


def phm12_accuracy(actual: Column, predicted: Column) -> Column:
    """Accuracy of one row: late predictions (error <= 0) halve at 5 percent, early ones at 20; null unless actual > 0."""
    error = 100 * F.try_divide(actual - predicted, actual)
    half = F.log(F.lit(0.5))
    return F.when(actual > 0, F.when(error <= 0, F.exp(-half * error / 5)).otherwise(F.exp(half * error / 20)))


def window_slope(y: Column, x: Column, w: WindowSpec) -> Column:
    """Least-squares slope over a frame; 0 for one row or a constant x."""
    return F.coalesce(F.regr_slope(y, x).over(w), F.lit(0.0))


def total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns))


def stable(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero: for results that are compared."""
    return F.round(col(c), digits) + F.lit(0.0)


def require(condition: Column, value: Column, message: str) -> Column:
    """value where the condition holds, else the job fails with message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))
