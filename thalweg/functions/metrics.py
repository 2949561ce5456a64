"""Model-skill metrics as aggregate columns over (true, predicted). Undefined ones are NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_error(true: Column, pred: Column) -> Column:
    return F.avg(true - pred)


def mean_absolute_error(true: Column, pred: Column) -> Column:
    return F.avg(F.abs(true - pred))


def mean_square_error(true: Column, pred: Column) -> Column:
    return F.avg((true - pred) * (true - pred))


def pearson_r(true: Column, pred: Column) -> Column:
    """The correlation; NaN if either side is constant."""
    r = F.covar_pop(true, pred) / F.nullif(F.stddev_pop(true) * F.stddev_pop(pred), F.lit(0.0))
    return F.coalesce(r, F.lit(float("nan")))


def kling_gupta_efficiency_2012(true: Column, pred: Column) -> Column:
    """1 less the distance from the ideal of correlation, ratio of means, and ratio of mean over deviation; NaN if a deviation or the true mean is 0."""
    mt, mp, st, sp = F.avg(true), F.avg(pred), F.stddev_pop(true), F.stddev_pop(pred)
    safe = lambda c: F.nullif(c, F.lit(0.0))
    r = F.covar_pop(true, pred) / safe(st * sp)
    beta = mp / safe(mt)
    gamma = (mp / safe(sp)) / safe(mt / safe(st))
    kge = 1 - F.sqrt((r - 1) * (r - 1) + (beta - 1) * (beta - 1) + (gamma - 1) * (gamma - 1))
    return F.coalesce(kge, F.lit(float("nan")))


me, mae, mse, kge2012 = mean_error, mean_absolute_error, mean_square_error, kling_gupta_efficiency_2012
