"""Readers and writers. Tables are Parquet, series, grids and weights also netCDF by the ending of their paths (sources.netcdf); whatever a column is
called at rest, it has its one name here."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from thalweg import __version__
from thalweg.operators.weights import WEIGHT_COLUMNS, numbered
from thalweg.session import written
from thalweg.sources import netcdf, positional


def read_params(spark: SparkSession, path: str, river_id: str = "river_id", position: bool = False) -> DataFrame:
    """river_id, downstream_river_id, k, x; if asked for, also position, the number of the row."""
    df = spark.read.parquet(path)
    found = (F.col(river_id).cast("long").alias("river_id"), F.col("downstream_river_id").cast("long"), F.col("k").cast("double"), F.col("x").cast("double"))
    return positional.numbered_rows(df).select(*found, "position") if position else df.select(*found)


def without_ids(spark: SparkSession, path: str | None) -> bool:
    """Whether a state or kernel file goes by the order of the parameters: a table without river_id, or sparse archives."""
    if not path:
        return False
    if positional.npz_files(path):
        return True
    try:
        return "river_id" not in spark.read.parquet(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def read_state(spark: SparkSession, path: str | None, net: DataFrame, discharge: str = "Q") -> DataFrame:
    """river_id, q of every river; zeros for rivers, or altogether where there is no file. A table of one column goes by the network's positions."""
    zero = net.select("river_id", F.lit(0.0).alias("q"))
    if not path:
        return zero
    if without_ids(spark, path):
        return positional.channel_state(spark, path, net)
    try:
        found = spark.read.parquet(path).select("river_id", F.col(discharge).cast("double").alias("q"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return zero
    return net.select("river_id").join(found, "river_id", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))


def write_state(state: DataFrame | None, path: str | None, discharge: str = "Q") -> None:
    """Writes river_id and the state; does nothing without either."""
    if state is not None and path:
        state.select("river_id", F.col("q").alias(discharge)).write.mode("overwrite").parquet(path)


def read_series(spark: SparkSession, paths: list[str], value: str, time: str = "time", river_id: str = "river_id") -> DataFrame:
    """source (the input's path), river_id, time, v: inputs stay apart by file or folder."""
    tables, cubes = [p for p in paths if not netcdf.is_netcdf(p)], [p for p in paths if netcdf.is_netcdf(p)]
    found = []
    if tables:
        df = spark.read.parquet(*tables).select(F.col("_metadata.file_path").alias("__file"), F.col(river_id).cast("long").alias("river_id"), F.col(time).alias("time"), F.col(value).cast("double").alias("v"))
        found.append(_with_source(df, tables))
    if cubes:
        df = netcdf.read(spark, cubes, f"`{river_id}` long, `{time}` timestamp_ntz, `{value}` double, source string")
        found.append(df.select(F.col(river_id).alias("river_id"), F.col(time).alias("time"), F.col(value).alias("v"), "source"))
    return reduce(DataFrame.unionByName, found)


def _with_source(df: DataFrame, paths: list[str]) -> DataFrame:
    """df with source: the path that its file (__file) is, or that the file's folder is below. Files are looked up, so that no row asks for more than a name."""
    if len(paths) == 1:
        return df.withColumn("source", F.lit(paths[0])).drop("__file")
    files = written(df.select("__file").distinct(), "files")  # a row a file
    found = files.select(F.col("__file").alias("__named"), _source(paths).alias("source"))
    return df.join(F.broadcast(found), F.col("__file") == F.col("__named"), "left").drop("__file", "__named")


def _source(paths: list[str]) -> Column:
    """Which of the paths a file (__file) is of."""
    # What Spark tells of a file is percent-encoded, and schemes are written in several ways (file:/x, file:///x): both are undone.
    plain = F.regexp_replace(F.url_decode(F.replace("__file", F.lit("+"), F.lit("%2B"))), "^[^/]*:/*", "/")
    own = {re.sub(r"^[^/]*:/*", "/", p).rstrip("/"): p for p in paths}
    known = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
    # A path is the beginning of its files' at as many steps as it has: one look-up for each number of steps among the paths.
    steps = sorted({k.count("/") for k in own}, reverse=True)
    # Paths may also be relative: then they are the end of a file's folder.
    near = F.filter(F.map_entries(known), lambda e: F.contains(plain, F.concat(F.lit("/"), e["key"], F.lit("/"))) | F.endswith(plain, F.concat(F.lit("/"), e["key"])))
    whole = F.filter(F.array(*(F.try_element_at(known, F.substring_index(plain, "/", n + 1)) for n in steps)), lambda x: x.isNotNull())
    return F.coalesce(F.get(whole, F.lit(0)), F.get(near, F.lit(0))["value"])


def read_grid(spark: SparkSession, paths: list[str], runoff: str = "ro", x: str = "x_index", y: str = "y_index", time: str = "time") -> DataFrame:
    """time, x_index, y_index, ro: many inputs are one cube. Of netCDF files x and y name dimensions, and their places are the indices."""
    tables, cubes = [p for p in paths if not netcdf.is_netcdf(p)], [p for p in paths if netcdf.is_netcdf(p)]
    found = []
    if tables:
        found.append(spark.read.parquet(*tables).select(F.col(time).alias("time"), F.col(x).cast("int").alias("x_index"), F.col(y).cast("int").alias("y_index"), F.col(runoff).cast("double").alias("ro")))
    if cubes:
        x, y = (f"{d.removesuffix('_index')}_index" for d in (x, y))
        df = netcdf.read(spark, cubes, f"`{time}` timestamp_ntz, `{x}` int, `{y}` int, `{runoff}` double")
        found.append(df.select(F.col(time).alias("time"), F.col(x).alias("x_index"), F.col(y).alias("y_index"), F.col(runoff).alias("ro")))
    return reduce(DataFrame.unionByName, found)


def read_weights(spark: SparkSession, path: str, river_id: str = "river_id") -> DataFrame:
    if netcdf.is_netcdf(path):
        kinds = {river_id: "long", "x_index": "int", "y_index": "int"}
        df = netcdf.read(spark, [path], ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in (river_id, *WEIGHT_COLUMNS[1:])))
        return df.withColumnRenamed(river_id, "river_id").select(*WEIGHT_COLUMNS)
    return spark.read.parquet(path).withColumnRenamed(river_id, "river_id").select(*WEIGHT_COLUMNS)


def read_weights_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """An older weight table: lon_index, lat_index, lon, lat become x and y; proportions are made from areas."""
    from thalweg.operators.weights import proportions

    renamed = {"lon_index": "x_index", "lat_index": "y_index", "lon": "x", "lat": "y"} | (names or {})
    df = spark.read.csv(path, header=True, inferSchema=True).withColumnsRenamed(renamed)
    return proportions(df.select(F.col("river_id").cast("long"), F.col("x_index").cast("int"), F.col("y_index").cast("int"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("area_sqm").cast("double")))


def cell_axes(coordinates: DataFrame, x: str = "lon", y: str = "lat") -> tuple[DataFrame, DataFrame]:
    """(x_index, x) and (y_index, y) of a regular grid, in ascending order, from a table of its coordinates."""
    from pyspark.sql import Window as W

    if missing := {x, y} - set(coordinates.columns):
        raise KeyError(f"missing variables: {sorted(missing)}")

    def axis(name: str, to: str) -> DataFrame:
        values = coordinates.select(F.col(name).cast("double").alias(to)).where(F.col(to).isNotNull()).distinct()
        return values.select((F.row_number().over(W.orderBy(to)) - 1).alias(f"{to}_index"), to)  # a row a grid line

    return axis(x, "x"), axis(y, "y")


def read_catchments(spark: SparkSession, path: str, river_id: str = "river_id", geometry: str = "geometry") -> DataFrame:
    """river_id, rings (an outer ring and its holes, arrays of points): a row a polygon, from well-known binary (Polygon, MultiPolygon)."""
    from thalweg.functions.geometry import polygons

    found = spark.read.parquet(path).select(F.col(river_id).cast("long").alias("river_id"), F.col(geometry).alias("geometry"))

    def parts(batches):
        listed = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        for batch in batches:
            shapes = [(river, polygon) for river, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for polygon in (polygons(shape) if shape else ())]
            rings = [ring for _, polygon in shapes for ring in polygon]
            points = np.concatenate([np.zeros((0, 2)), *rings])
            points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["x", "y"])
            rings = listed(listed(points, [len(r) for r in rings]), [len(polygon) for _, polygon in shapes])
            yield pa.RecordBatch.from_arrays([pa.array([river for river, _ in shapes], pa.int64()), rings], ["river_id", "rings"])

    return found.mapInArrow(parts, "river_id long, rings array<array<struct<x:double,y:double>>>")


def write_cells(cells: DataFrame, path: str) -> None:
    """Writes grid cells: their bounds, centres and indices."""
    cells.select("x_index", "y_index", "x", "y", "x_min", "x_max", "y_min", "y_max").write.mode("overwrite").parquet(path)


def write_subset(net: DataFrame, target: int, params_path: str, weights: DataFrame | None = None, weights_path: str | None = None) -> None:
    """Writes the network above a river, and its weights if a path is given."""
    from thalweg.operators.network import subset

    part, few = subset(net, target, weights if weights_path else None)
    part.write.mode("overwrite").parquet(params_path)
    if few is not None:
        write_weights(few, weights_path, subset_of=str(target))


def write_weights(weights: DataFrame, path: str, **provenance: str) -> None:
    """Writes weights with their provenance as metadata of the proportion column."""
    about = {"description": "shares of grid cells in river catchments", "version": __version__} | provenance
    if netcdf.is_netcdf(path):
        kinds = {c: "long" if c == "river_id" or c.endswith("_index") else "double" for c in WEIGHT_COLUMNS}
        rows = numbered(weights.select(*WEIGHT_COLUMNS), "river_id", F.desc("area_sqm"), "x_index", "y_index", name="index")
        netcdf.write(rows, path, {"index": "place"}, kinds, about, {"area_sqm": {"units": "m2"}, "proportion": {"units": "1"}})
        return
    weights.select(*WEIGHT_COLUMNS).withMetadata("proportion", {"provenance": json.dumps(about)}).write.mode("overwrite").parquet(path)


def write_kernel(kernel: DataFrame, path: str, tr: int | None = None) -> None:
    """Writes kernels (river_id, step, u), and the seconds of their steps as metadata: volumes hold only where these are those of the inflow."""
    kernel.select("river_id", "step", "u").withMetadata("u", {"tr": int(tr)} if tr else {}).write.mode("overwrite").parquet(path)


def kernel_step(spark: SparkSession, path: str) -> int | None:
    """The seconds of a kernel file's steps, if it tells."""
    if positional.npz_files(path):
        return None
    return spark.read.parquet(path).schema["u"].metadata.get("tr")


def read_kernel(spark: SparkSession, path: str, net: DataFrame | None = None) -> DataFrame:
    """river_id, kernel (array by step). Sparse archives (.npz, or a folder of them) need the network with positions."""
    from thalweg.functions.kernels import packed

    if files := positional.npz_files(path):
        if net is None:
            raise ValueError("sparse kernels need the network")
        return positional.kernels(spark, files, net)
    return packed(spark.read.parquet(path), "step", "u", "kernel")


def write_kernel_state(state: DataFrame, path: str) -> None:
    state.select("river_id", "state").write.mode("overwrite").parquet(path)


def read_kernel_state(spark: SparkSession, path: str, kernels: DataFrame, net: DataFrame | None = None) -> DataFrame:
    """river_id, state; its length must be the kernel's. A table without ids, a column a step, needs the network with positions."""
    if net is not None and without_ids(spark, path):
        found = positional.kernel_state(spark, path, net)
    else:
        found = spark.read.parquet(path)
    df = found.join(kernels, "river_id")
    fits = F.when(F.size("state") == F.size("kernel"), F.col("state")).otherwise(F.raise_error(F.lit("a state does not fit its kernel")).cast("array<double>"))
    return df.select("river_id", fits.alias("state"))


def discharge_names(inputs: list[str], folder: str | None, explicit: list[str] | None = None) -> list[str]:
    """Where discharge goes: explicit paths, or discharge_<input's name> in a folder (discharge.parquet without inputs)."""
    if bool(folder) == bool(explicit):
        raise ValueError("give either discharge_dir or discharge_files")
    if explicit:
        return explicit
    return [f"{folder.rstrip('/')}/discharge_{re.split(r'[/\\]', p.rstrip('/'))[-1]}" for p in inputs] or [f"{folder.rstrip('/')}/discharge.parquet"]


def suggested_name(first: datetime, last: datetime) -> str:
    return f"qlateral_{first:%Y%m%d%H}_{last:%Y%m%d%H}.parquet"


def with_dates(df: DataFrame, start: str | datetime, step: int) -> DataFrame:
    """df with `time` from the step number t."""
    text = start if isinstance(start, str) else start.isoformat(" ")
    return df.withColumn("time", F.expr(f"timestampadd(SECOND, cast(t AS BIGINT) * {int(step)}, TIMESTAMP_NTZ'{text}')"))


def seconds_since(time: Column, start: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), time)


Sink = Callable[[DataFrame, str, str], None]


def write_discharge(df: DataFrame, path: str, source: str = "", name: str = "Q") -> None:
    """The default sink: river_id, time, discharge as float, with units and source as metadata; a netCDF file (time, river_id) where the path says so."""
    if netcdf.is_netcdf(path):
        about = {"units": "m3 s-1", "long_name": "Discharge at catchment outlet", "standard_name": "discharge", "aggregation_method": "mean"}
        netcdf.write(df.withColumnRenamed("q", name), path, {"time": "time", "river_id": "long"}, {name: "float"}, {"runoff_file": source, "version": __version__}, {name: about})
        return
    q = F.col("q").cast("float").alias(name, metadata={"units": "m3 s-1", "source": source, "version": __version__})
    df.select("river_id", "time", q).write.mode("overwrite").parquet(path)


def selected_rivers(sink: Sink, rivers: list[int]) -> Sink:
    """A sink that passes some rivers on."""
    return lambda df, path, source: sink(df.where(F.col("river_id").isin(rivers)), path, source)
