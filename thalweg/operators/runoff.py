"""From gridded runoff to lateral inflow: weighted aggregation and repair of time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Depth units that are understood, in metres. A kilogram a square metre counts as a metre, as in the data that this follows.
UNITS = {"m": 1.0, "meters": 1.0, "kg m-2": 1.0, "mm": 0.001, "millimeters": 0.001}


def unit_factor(unit: str | None) -> float:
    """Metres for one of the unit; None counts as metres."""
    if unit is not None and unit not in UNITS:
        raise ValueError(f"unknown depth unit: {unit!r}")
    return UNITS.get(unit, 1.0)


def unit_factor_column(unit: Column) -> Column:
    """unit_factor by row; an unknown unit stops the query."""
    known = F.when(unit.isNull(), F.lit(1.0))
    for name, factor in UNITS.items():
        known = known.when(unit == name, F.lit(factor))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown depth unit: "), unit)).cast("double"))


def cells_needed(weights: DataFrame) -> DataFrame:
    """The distinct cells that weights refer to."""
    return weights.select("x_index", "y_index").distinct()


def aggregate(grid: DataFrame, weights: DataFrame, factor: float = 1.0, time: str = "t") -> DataFrame:
    """river_id, time, v: the area-weighted mean depth of each catchment. NaN or null in a cell makes the river's step NaN.

    Weights are small beside the cube in most uses; whether to broadcast them is left to the optimizer's size estimate.
    """
    ro = F.coalesce(F.col("ro"), F.lit(float("nan")))
    joined = grid.join(weights.select("river_id", "x_index", "y_index", "proportion"), ["x_index", "y_index"])
    return joined.groupBy("river_id", time).agg(F.sum(ro * F.col("proportion") * factor).alias("v"))


def _series(time: str) -> W:
    return W.partitionBy("river_id").orderBy(time)


def to_incremental(df: DataFrame, time: str = "t") -> DataFrame:
    """Differences of a cumulative series; the first value stays."""
    w = _series(time)
    before = F.lag("v").over(w)
    return df.withColumn("v", F.when(F.row_number().over(w) == 1, F.col("v")).otherwise(F.col("v") - before))


def to_cumulative(df: DataFrame, time: str = "t") -> DataFrame:
    """Running sums that pass over NaN and stay NaN there."""
    w = _series(time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.sum(F.nanvl("v", F.lit(0.0))).over(w)))


def positive(v: Column) -> Column:
    """Negative values as 0; NaN stays."""
    return F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(0.0)))


def filled(v: Column) -> Column:
    """NaN and null as 0."""
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def resample_uniform(df: DataFrame, time: str = "t", step: int | None = None) -> DataFrame:
    """A series on a uniform grid with the first step's width: cumulated, put on the grid (samples off it are dropped), linearly interpolated and
    differenced again. Grid points before a first or after a last known value take the nearest one's place as missing and as held."""
    w = _series(time)
    if step is None:
        # The width of the first step of each river; a river with one row keeps it.
        first = df.withColumn("__n", F.row_number().over(w)).groupBy("river_id").agg(F.min(time).alias("__from"), F.max(time).alias("__to"), (F.min(F.when(F.col("__n") == 2, F.col(time))) - F.min(time)).alias("__step"))
    else:
        first = df.groupBy("river_id").agg(F.min(time).alias("__from"), F.max(time).alias("__to"), F.lit(step).cast(df.schema[time].dataType).alias("__step"))
    on = first.select("river_id", F.explode(F.sequence("__from", "__to", F.coalesce("__step", F.lit(1).cast(df.schema[time].dataType)))).alias(time))
    known = on.join(to_cumulative(df, time), ["river_id", time], "left").withColumn("__v", F.when(~F.isnan("v"), F.col("v")))
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("__v").isNotNull(), F.col(time))
    known = known.select("river_id", time, F.last("__v", True).over(back).alias("v0"), F.last(at, True).over(back).alias("t0"), F.first("__v", True).over(ahead).alias("v1"), F.first(at, True).over(ahead).alias("t1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(time) - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0).cast("long"))
    value = F.when(F.col("t0") == F.col("t1"), F.col("v0")).when(F.col("v0").isNull(), F.lit(float("nan"))).when(F.col("v1").isNull(), F.col("v0")).otherwise(between)
    return to_incremental(known.select("river_id", time, value.alias("v")), time)


def is_uniform(df: DataFrame, time: str = "t") -> bool:
    """Whether all steps of all rivers have one width."""
    gap = df.select((F.lead(time).over(_series(time)) - F.col(time)).alias("gap"))
    low, high = gap.agg(F.min("gap"), F.max("gap")).first()
    return low == high


def to_qlateral(
    grid: DataFrame, weights: DataFrame, *, unit: str | None = None, cumulative: bool = False, force_positive: bool = False, uniform: bool = False, volumes: bool = False, time: str = "t"
) -> DataFrame:
    """river_id, time, v: lateral inflow depths in metres, or volumes in cubic metres. Aggregated first, then differenced: both are linear."""
    df = aggregate(grid, weights, unit_factor(unit), time)
    if cumulative:
        df = to_incremental(df, time)
    if force_positive:
        df = df.withColumn("v", positive(F.col("v")))
    if uniform:
        df = resample_uniform(df, time)
    df = df.withColumn("v", filled(F.col("v")))
    if volumes:
        areas = weights.groupBy("river_id").agg(F.sum("area_sqm").alias("__area"))
        df = df.join(areas, "river_id").withColumn("v", F.col("v") * F.col("__area")).drop("__area")
    return df.select("river_id", time, "v")
