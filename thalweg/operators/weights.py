"""Grid cells, catchments and the weights between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.functions.geometry import AXIS, cover, equal_area_y
from thalweg.session import written

WEIGHT_COLUMNS = ("river_id", "x_index", "y_index", "x", "y", "area_sqm", "proportion")


def proportions(df: DataFrame, river_id: str = "river_id") -> DataFrame:
    """Each cell's share of its catchment's area; shares of a river sum to 1."""
    columns = [c if c != "river_id" else river_id for c in WEIGHT_COLUMNS]
    return df.withColumn("proportion", F.col("area_sqm") / F.sum("area_sqm").over(W.partitionBy(river_id))).select(*columns)


def wrapped(x: Column) -> Column:
    """Longitudes over 180 degrees as negative ones."""
    return F.when(x > 180, x - 360).otherwise(x)


def bounds(axis: DataFrame, index: str, value: str, margin: float) -> DataFrame:
    """index, value, low, high: cell borders half way between neighbours; the outer ones lie `margin` beyond the outer centres.

    An axis has one row a grid line, so one task orders it.
    """
    w = W.orderBy(value)
    v = F.col(value)
    return axis.select(index, value, F.coalesce((v + F.lag(v).over(w)) / 2, v - margin).alias("low"), F.coalesce((v + F.lead(v).over(w)) / 2, v + margin).alias("high"))


def cells(x_axis: DataFrame, y_axis: DataFrame) -> DataFrame:
    """Nearest-centre regions of a regular grid: rectangles x_min, x_max, y_min, y_max with x_index, y_index and their centroid x, y.

    Longitudes are wrapped; x_index stays that of the grid. Outer regions reach the centres' bounding box grown by its longer side.
    """
    x_axis = x_axis.withColumn("x", wrapped(F.col("x")))
    ex, ey = x_axis.agg(F.min("x"), F.max("x")).first(), y_axis.agg(F.min("y"), F.max("y")).first()
    if ex[0] is None or ey[0] is None:
        raise ValueError("a grid needs at least one x and one y coordinate")
    margin = float(max(ex[1] - ex[0], ey[1] - ey[0]))
    bx = bounds(x_axis, "x_index", "x", margin).select("x_index", F.col("low").alias("x_min"), F.col("high").alias("x_max"))
    by = bounds(y_axis, "y_index", "y", margin).select("y_index", F.col("low").alias("y_min"), F.col("high").alias("y_max"))
    both = bx.crossJoin(by)  # the grid itself
    return both.withColumn("x", (F.col("x_min") + F.col("x_max")) / 2).withColumn("y", (F.col("y_min") + F.col("y_max")) / 2)


def nearest(points: DataFrame, axis: DataFrame, index: str, value: str, point: str, name: str) -> DataFrame:
    """points with `name`: the index of the axis's nearest value (the smaller index of two as near). An axis has a row a grid line."""
    lines = axis.agg(F.collect_list(F.struct(F.col(value).alias("v"), F.col(index).alias("i"))).alias("__lines"))
    best = F.array_min(F.transform("__lines", lambda p: F.struct(F.abs(p["v"] - F.col(point)).alias("d"), p["i"].alias("i"))))
    return points.crossJoin(F.broadcast(lines)).withColumn(name, best["i"]).drop("__lines")  # one row


def in_order(grid_cells: DataFrame) -> DataFrame:
    """Cells in the order of their x, then y."""
    return grid_cells.orderBy("x", "y")


def overlay(grid_cells: DataFrame, catchments: DataFrame, river_id: str = "river_id") -> DataFrame:
    """Weights from the areas of cells within catchments, in the order of river, then area descending.

    catchments: river_id and ring (an array of points), or rings (an outer ring and its holes); a river of several parts has several rows. Rows without
    a shape give nothing. grid_cells: cells of a grid, all or some of them; each x_index has one pair of borders, and each y_index.

    Rings are never shuffled or joined: a grid is known by its lines, of which every task gets the borders, and a quadtree over ranges of lines covers
    the shapes of a whole batch (geometry.cover). Blocks of cells inside of a shape come out as ranges and are measured by Spark; only border cells are cut.
    """
    shape = "rings" if "rings" in catchments.columns else "ring"
    for need, df in (({river_id, shape}, catchments), ({"x_index", "y_index", "x", "y", "x_min", "x_max", "y_min", "y_max"}, grid_cells)):
        if missing := need - set(df.columns):
            raise KeyError(f"missing columns: {sorted(missing)}")
    spark = grid_cells.sparkSession
    axes = {a: _lines(grid_cells, a) for a in "xy"}  # a row a grid line
    borders = {a: np.array([(r["low"], r["high"]) for r in rows], float).reshape(-1, 2) for a, rows in axes.items()}
    given = spark.sparkContext.broadcast(borders)
    rings = F.col("rings") if shape == "rings" else F.array("ring")
    point = "array<array<struct<x:double,y:double>>>"
    shapes = catchments.select(F.col(river_id), rings.cast(point).alias("rings")).where("rings IS NOT NULL")
    schema = shapes.select(river_id).schema.add("i0", "integer").add("i1", "integer").add("j0", "integer").add("j1", "integer").add("area", "double")

    def measured(batches):
        x_lines, y_lines = given.value["x"], given.value["y"]
        for whole in batches:
            for at in range(0, whole.num_rows, SHAPES):
                batch = whole.slice(at, SHAPES)
                of_ring, of_point = batch.column("rings"), batch.column("rings").flatten()
                points = of_point.flatten()
                points = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
                n_rings, n_points = (np.diff(x.offsets.to_numpy()) for x in (of_ring, of_point))
                ring = np.repeat(np.arange(len(n_points)), n_points)
                owner = np.repeat(np.arange(batch.num_rows), n_rings)
                hole = np.arange(len(owner)) > (np.cumsum(n_rings) - n_rings)[owner]
                inside, who, cell, area = cover(points, ring, owner, hole, x_lines, y_lines)
                ids = batch.column(river_id).take(pa.array(np.concatenate([inside[:, 0], who])))
                ranges = [np.concatenate([inside[:, 1 + k], cell[:, k // 2] + k % 2]) for k in range(4)]
                areas_ = pa.array(np.concatenate([np.zeros(len(inside)), area]), mask=np.arange(len(ids)) < len(inside))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(r, pa.int32()) for r in ranges), areas_], schema.names)

    blocks = shapes.mapInArrow(measured, schema)
    each = blocks.withColumn("i", F.explode(F.sequence("i0", F.col("i1") - 1))).withColumn("j", F.explode(F.sequence("j0", F.col("j1") - 1)))
    for a, place in (("x", "i"), ("y", "j")):
        known = [(k, r["index"], r["centre"], float(size)) for (k, r), size in zip(enumerate(axes[a]), _extents(borders[a], a), strict=True)]
        lines = spark.createDataFrame(known, f"__{place} int, {a}_index int, {a} double, __{a} double")
        each = each.join(F.broadcast(lines), F.col(place) == F.col(f"__{place}"))
    each = each.select(river_id, "x_index", "y_index", "x", "y", F.coalesce("area", F.col("__x") * F.col("__y")).alias("area_sqm"))
    if grid_cells.count() < len(axes["x"]) * len(axes["y"]):
        each = each.join(grid_cells.select("x_index", "y_index"), ["x_index", "y_index"], "left_semi").select(*each.columns)
    parts = each.where("area_sqm > 0").groupBy(river_id, "x_index", "y_index", "x", "y").agg(F.sum("area_sqm").alias("area_sqm"))
    return proportions(parts, river_id).orderBy(river_id, F.desc("area_sqm"), "x_index", "y_index")


#: Shapes that a task covers at a time.
SHAPES = 256


def _lines(grid_cells: DataFrame, axis: str) -> list:
    """index, centre, low, high of the lines of one axis, in order."""
    lines = grid_cells.groupBy(F.col(f"{axis}_index").cast("int").alias("index")).agg(F.min(axis).alias("centre"), F.min(f"{axis}_min").alias("low"), F.max(f"{axis}_min").alias("low2"), F.max(f"{axis}_max").alias("high"), F.min(f"{axis}_max").alias("high2"))
    found = sorted(lines.collect(), key=lambda r: r["low"])
    if any(r["low"] != r["low2"] or r["high"] != r["high2"] for r in found) or any(a["high"] > b["low"] for a, b in zip(found, found[1:], strict=False)):
        raise ValueError(f"cells do not form a grid: an {axis}_index has several borders, or lines overlap")
    return found


def _extents(borders: np.ndarray, axis: str) -> np.ndarray:
    """Width of each line in the equal-area projection, in metres."""
    return AXIS * np.radians(borders[:, 1] - borders[:, 0]) if axis == "x" else equal_area_y(borders[:, 1]) - equal_area_y(borders[:, 0])


def in_network_order(weights: DataFrame, order: DataFrame, river_id: str = "river_id") -> DataFrame:
    """Weights with `row`: the place of each row when rivers come in the order of `order` (river_id, position; unknown ones last), larger areas first."""
    joined = weights.join(order.select(river_id, "position"), river_id, "left")
    return joined.orderBy(F.col("position").asc_nulls_last(), F.desc("area_sqm"), "x_index", "y_index")


def numbered(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """df with the place of each row, from 1, in an order: sorted by ranges, then counted on from the rows of the ranges before. No row leaves its range."""
    ranges = written(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    counts = ranges.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    placed = ranges.join(F.broadcast(starts), part == F.col("__part"))
    return placed.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__before")
