"""Grid weights in one call: from a grid's coordinates and catchment polygons to the table that runoff aggregation reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import weights
from thalweg.sources import io


def grid_weights(
    spark: SparkSession,
    grid_path: str,
    catchments_path: str,
    *,
    var_x: str = "lon",
    var_y: str = "lat",
    var_river_id: str = "river_id",
    geometry: str = "geometry",
    save_voronoi_path: str | None = None,
    save_weights_path: str | None = None,
    routing_params_path: str | None = None,
) -> DataFrame:
    """The shares of grid cells in catchments, larger areas of a river first; in the order of the parameters' rows where their path is given.

    grid_path: any table with the coordinate columns; catchments_path: polygons as well-known binary.
    """
    cells = weights.cells(*io.cell_axes(spark.read.parquet(grid_path).select(var_x, var_y), var_x, var_y))
    if save_voronoi_path:
        io.write_cells(weights.in_order(cells), save_voronoi_path)
    found = weights.overlay(cells, io.read_catchments(spark, catchments_path, var_river_id, geometry))
    if routing_params_path:
        rows = spark.read.parquet(routing_params_path).select(F.col(var_river_id).cast("long").alias("river_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        first = rows.groupBy("river_id").agg(F.min(F.struct("file", "at")).alias("position"))
        found = weights.in_network_order(found, first)
    if save_weights_path:
        io.write_weights(found, save_weights_path, grid=grid_path, catchments=catchments_path)
    return found
