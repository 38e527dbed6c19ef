"""Two-column statistics that give null, not an error, where a side is constant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _over(agg: Column, window) -> Column:
    return agg if window is None else agg.over(window)


def correlation(x: Column | str, y: Column | str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(y: Column, x: Column, window=None) -> Column:
    """Least-squares slope of y on x over rows where both exist."""
    x = F.when(y.isNotNull(), x)
    y = F.when(x.isNotNull(), y)
    return F.try_divide(_over(F.covar_pop(x, y), window), _over(F.var_pop(x), window))


def intercept(y: Column, x: Column, window=None) -> Column:
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    return _over(F.avg(both_y), window) - slope(y, x, window) * _over(F.avg(both_x), window)
