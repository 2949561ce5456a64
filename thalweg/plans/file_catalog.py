"""Queries that go through files: the views are written, then read, routed and written again by the readers, sinks, routers and the command line.

Each run writes to a folder of its own below the session's shared one.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry, kernels
from thalweg.operators import network, weights
from thalweg.plans import cli
from thalweg.plans.catalog import _BOUNDS, _CONV, _MEMBERS, _UNIT, _UP, _Y, GRID_START, HOUR, TARGET, H, _depths, _kernel_sql, _kernels, _mean_sql, query, r6
from thalweg.plans.config import Config
from thalweg.plans.grid_weights import grid_weights
from thalweg.plans.routers import RapidMuskingum, UnitMuskingum, first_step
from thalweg.session import shared_dir, written
from thalweg.sources import cache, io, netcdf, positional, store, views
from thalweg.sources.views import START, sql
from thalweg.streaming.incremental import convolved
from thalweg.streaming.routed import routed


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme."""
    base = shared_dir(spark)
    return f"{base if '://' in base else 'file://' + os.path.abspath(base)}/{name}-{uuid.uuid4().hex}"


def params_of(spark, d) -> str:
    path = place(spark, "params")
    views.net(spark, d).write.parquet(path)
    return path


@query(sql("SELECT river_id, downstream_river_id, k, x FROM net", "net"))
def params_file(spark, d):
    """Parameters whose id column has another name, and columns that are not read."""
    path = place(spark, "params")
    views.net(spark, d).withColumnRenamed("river_id", "linkno").withColumn("extra", F.lit(1)).write.parquet(path)
    return io.read_params(spark, path, "linkno")


@query(sql("SELECT river_id, CASE WHEN river_id % 4 = 1 THEN 0.0::DOUBLE ELSE q END AS q FROM state", "state"))
def state_file(spark, d):
    """A state without some rivers, which start from nothing."""
    path = place(spark, "state")
    io.write_state(views.state(spark, d).where("river_id % 4 <> 1"), path)
    return io.read_state(spark, path, views.net(spark, d))


@query(sql("SELECT CASE WHEN t < 24 THEN 'first' ELSE 'rest' END AS input, river_id, count(*) AS n, round(sum(v), 6) AS v FROM qlateral GROUP BY 1, 2", "qlateral"))
def qlateral_files(spark, d):
    """Two inputs read at once and told apart by their paths."""
    base, q = place(spark, "qlateral"), views.qlateral(spark, d)
    for name, rows in (("first", q.where("t < 24")), ("rest", q.where("t >= 24"))):
        rows.select("river_id", "time", F.col("v").alias("qlateral")).write.parquet(f"{base}/{name}.parquet")
    found = io.read_series(spark, [f"{base}/first.parquet", f"{base}/rest.parquet"], "qlateral")
    return found.withColumn("input", F.regexp_extract("source", r"(\w+)\.parquet$", 1)).groupBy("input", "river_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), "v"))


@query(sql(f"SELECT TIMESTAMP '{GRID_START}' + to_hours(CAST(t AS BIGINT)) AS time, x_index, y_index, round(ro, 6) AS ro FROM grid", "grid"))
def grid_files(spark, d):
    """A cube in two files, with names of its own for its columns."""
    base = place(spark, "grid")
    g = io.with_dates(views.grid(spark, d), GRID_START, HOUR).select("t", F.col("time").alias("valid_time"), F.col("x_index").alias("lon_i"), F.col("y_index").alias("lat_i"), F.col("ro").alias("runoff"))
    for k in (0, 1):
        g.where(F.col("t") % 2 == k).drop("t").write.parquet(f"{base}/{k}")
    return io.read_grid(spark, [f"{base}/0", f"{base}/1"], "runoff", "lon_i", "lat_i", "valid_time").withColumn("ro", r6("ro", "ro"))


_WEIGHTS = sql("SELECT river_id, x_index, y_index, x, y, area_sqm, round(proportion, 6) AS proportion FROM weights", "weights")


@query(_WEIGHTS)
def weights_file(spark, d):
    path = place(spark, "weights")
    io.write_weights(views.weights(spark, d), path, grid="derived")
    return io.read_weights(spark, path).withColumn("proportion", r6("proportion", "p"))


@query(_WEIGHTS)
def weights_csv_file(spark, d):
    """An older table as CSV: other names, no proportions."""
    path = place(spark, "weights-csv")
    old = {"x_index": "lon_index", "y_index": "lat_index", "x": "lon", "y": "lat"}
    views.weights(spark, d).drop("proportion").withColumnsRenamed(old).write.csv(path, header=True)
    return io.read_weights_csv(spark, path).withColumn("proportion", r6("proportion", "p"))


@query(sql(f"SELECT river_id, step, round(u, 6) AS u FROM {_kernel_sql('curvilinear')}", "uh_inputs"))
def kernel_file(spark, d):
    path = place(spark, "kernel")
    io.write_kernel(kernels.kernel(views.uh_inputs(spark, d), HOUR), path, HOUR)
    return io.read_kernel(spark, path).select("river_id", F.posexplode("kernel").alias("step", "u")).withColumn("u", r6("u", "u"))


@query(sql(f"SELECT river_id, CAST(t - {H} AS INT) AS step, round(q, 6) AS carry FROM {_CONV} WHERE t >= {H}", "uh_inputs", "qlateral"))
def kernel_state_file(spark, d):
    path, own = place(spark, "kernel-state"), _kernels(spark, d)
    io.write_kernel_state(kernels.convolve(kernels.packed(_depths(spark, d), "t", "v", "v"), own), path)
    carry = F.slice("state", F.lit(1), F.size("state") - 1)  # the last place is always 0
    return io.read_kernel_state(spark, path, own).select("river_id", F.posexplode(carry).alias("step", "carry")).withColumn("carry", r6("carry", "carry"))


@query("SELECT 'x' AS axis, CAST(i AS INT) AS place, i * 30.0::DOUBLE AS value FROM (SELECT DISTINCT p_partkey % 12 AS i FROM part) UNION ALL SELECT 'y', CAST(i AS INT), i * 15.0::DOUBLE - 60 FROM (SELECT DISTINCT s_suppkey % 9 AS i FROM supplier)")
def grid_axes(spark, d):
    """The axes of a regular grid from a table of its cells' coordinates."""
    path, (x, y) = place(spark, "coordinates"), views.axes(spark, d)
    x.select(F.col("x").alias("lon")).crossJoin(y.select(F.col("y").alias("lat"))).write.parquet(path)
    x_axis, y_axis = io.cell_axes(spark.read.parquet(path))
    named = lambda df, a: df.select(F.lit(a).alias("axis"), F.col(f"{a}_index").cast("int").alias("place"), F.col(a).alias("value"))
    return named(x_axis, "x").union(named(y_axis, "y"))


@query(sql(f"SELECT CAST(n_nationkey + 1 AS BIGINT) AS river_id, CAST(arg_min(i, abs(x - (n_nationkey * 11.0::DOUBLE - 140)) * 1000 + i) AS INT) AS x_index FROM nation CROSS JOIN (SELECT i, i * 30.0::DOUBLE AS x FROM range(12) r(i)) GROUP BY 1", "net"))
def nearest_lines(spark, d):
    """The grid line nearest to each box's left side; the smaller index of two as near."""
    boxes = views.boxes(spark, d).select("river_id", F.col("ring")[0]["x"].alias("left"))
    return weights.nearest(boxes, views.axes(spark, d)[0], "x_index", "x", "left", "x_index").select("river_id", "x_index")


@query(sql(f"SELECT n.river_id, CASE WHEN n.river_id = {TARGET} THEN -1 ELSE downstream_river_id END AS downstream_river_id, (SELECT count(*) FROM weights w WHERE w.river_id = n.river_id) AS cells FROM net n WHERE n.river_id IN (WITH RECURSIVE {_UP} SELECT river_id FROM up)", "net", "weights"))
def subset_files(spark, d):
    """The network above a river and its weights, written and read again."""
    base = place(spark, "subset")
    io.write_subset(views.net(spark, d), TARGET, f"{base}/params", views.weights(spark, d), f"{base}/weights")
    cells = io.read_weights(spark, f"{base}/weights").groupBy("river_id").agg(F.count(F.lit(1)).alias("cells"))
    return io.read_params(spark, f"{base}/params").select("river_id", "downstream_river_id").join(cells, "river_id")


@query(f"WITH {_BOUNDS} SELECT * FROM cells")
def cells_file(spark, d):
    """Grid cells as the weights' maker saves them."""
    path = place(spark, "cells")
    io.write_cells(weights.in_order(weights.cells(*views.axes(spark, d))), path)
    return spark.read.parquet(path).select("x_index", "y_index", "x_min", "x_max", "y_min", "y_max", "x", "y")


_SHAPES = """SELECT CAST(n_nationkey + 1 AS BIGINT) AS river_id, sign, n_nationkey * 9.0::DOUBLE - 120 + a AS x0, n_nationkey * 3.0::DOUBLE - 50 + b AS y0, n_nationkey * 9.0::DOUBLE - 120 + c AS x1, n_nationkey * 3.0::DOUBLE - 50 + e AS y1
    FROM nation CROSS JOIN (VALUES (1, 0, 0, 14, 4), (1, 0, 4, 6, 10), (1, 20, 0, 40, 12), (-1, 24, 3, 35, 9)) v(sign, a, b, c, e)"""


@query(
    f"""WITH {_BOUNDS}, s AS ({_SHAPES}),
    i AS (SELECT river_id, sign, x_index, y_index, greatest(x_min, x0) AS a, least(x_max, x1) AS c, greatest(y_min, y0) AS s, least(y_max, y1) AS n FROM s JOIN cells ON x_min < x1 AND x_max > x0 AND y_min < y1 AND y_max > y0),
    m AS (SELECT river_id, x_index, y_index, sum(sign * {geometry.AXIS} * radians(c - a) * ({_Y.replace("Z", "n")} - {_Y.replace("Z", "s")})) AS area FROM i GROUP BY 1, 2, 3)
    SELECT river_id, x_index, y_index, round(area / 1000000, 3) AS area_sqkm, round(area / sum(area) OVER (PARTITION BY river_id), 6) AS proportion FROM m WHERE area > 1"""
)
def grid_weights_call(spark, d):
    """Weights in one call, from files: L-shaped catchments, and others with a hole, as well-known binary."""
    base, (x, y) = place(spark, "grid-weights"), views.axes(spark, d)
    x.select(F.col("x").alias("lon")).crossJoin(y.select(F.col("y").alias("lat"))).write.parquet(f"{base}/grid")
    views.wkb_catchments(spark, d).write.parquet(f"{base}/catchments")
    views.net(spark, d).write.parquet(f"{base}/params")
    grid_weights(spark, f"{base}/grid", f"{base}/catchments", save_voronoi_path=f"{base}/cells", save_weights_path=f"{base}/weights", routing_params_path=f"{base}/params")
    w = io.read_weights(spark, f"{base}/weights").where("area_sqm > 1")
    return w.select("river_id", "x_index", "y_index", F.round(F.col("area_sqm") / 1_000_000, 3).alias("area_sqkm"), r6("proportion", "proportion"))


# --- files without ids ------------------------------------------------------------------------------------------------------------------------


def ordered(df: DataFrame, path: str, files: int, *columns: str) -> str:
    """Rivers in order over some files, and of these the columns alone."""
    df.repartitionByRange(files, "river_id").sortWithinPartitions("river_id").select(*columns).write.parquet(path)
    return path


def ordered_net(spark, d, files: int = 3) -> DataFrame:
    return io.read_params(spark, ordered(views.net(spark, d), place(spark, "params"), files, "river_id", "downstream_river_id", "k", "x"), position=True)


@query(sql("SELECT river_id, CAST(row_number() OVER (ORDER BY river_id) - 1 AS BIGINT) AS position, q FROM state", "state"))
def state_positional(spark, d):
    """A state of one column in four files, beside parameters in three: rows meet by their numbers over all files."""
    net = ordered_net(spark, d)
    path = ordered(views.state(spark, d).withColumnRenamed("q", "Q"), place(spark, "state"), 4, "Q")
    return io.read_state(spark, path, net).join(net.select("river_id", "position"), "river_id")


@query(sql(f"SELECT river_id, step, round(u, 6) AS u FROM {_kernel_sql('curvilinear')}", "uh_inputs"))
def kernel_npz(spark, d):
    """Sparse kernels in archives of 32 rivers each, without ids."""
    net, folder = ordered_net(spark, d), place(spark, "kernel")
    positional.write_kernels(kernels.kernel(views.uh_inputs(spark, d), HOUR), net, folder, 32)
    return io.read_kernel(spark, folder, net).select("river_id", F.posexplode("kernel").alias("step", "u")).withColumn("u", r6("u", "u"))


@query(sql(f"SELECT river_id, CAST(t - {H} AS INT) AS step, round(q, 6) AS carry FROM {_CONV} WHERE t >= {H}", "uh_inputs", "qlateral"))
def kernel_state_positional(spark, d):
    """A carry-over with a column a step and no ids."""
    net, own = ordered_net(spark, d), written(_kernels(spark, d), "kernels")
    steps = own.agg(F.max(F.size("kernel"))).first()[0]
    state = kernels.convolve(kernels.packed(_depths(spark, d), "t", "v", "v"), own).select("river_id", *(F.col("state")[k].alias(str(k)) for k in range(steps)))
    path = ordered(state, place(spark, "kernel-state"), 4, *map(str, range(steps)))
    carry = F.slice("state", F.lit(1), F.size("state") - 1)  # the last place is always 0
    return io.read_kernel_state(spark, path, own, net).select("river_id", F.posexplode(carry).alias("step", "carry")).withColumn("carry", r6("carry", "carry"))


# --- netCDF ---------------------------------------------------------------------------------------------------------------------------------


@query(sql("SELECT river_id, time, round(v, 6) AS v FROM qlateral WHERE t >= 24 AND t < 96", "qlateral"))
def qlateral_netcdf(spark, d):
    """Lateral inflow as one netCDF file (time, river), written by tasks at their offsets; three days of it are read, in blocks of a few steps."""
    path, q = place(spark, "qlateral"), views.qlateral(spark, d)
    netcdf.write(q.withColumnRenamed("v", "qlateral"), f"{path}.nc", {"time": "time", "river_id": "long"}, {"qlateral": "double"}, about={"qlateral": {"units": "m3"}})
    start = datetime.fromisoformat(START)
    found = netcdf.read(spark, [f"{path}.nc"], "time timestamp_ntz, river_id long, qlateral double", start + timedelta(hours=24), start + timedelta(hours=96), block=4096)
    return found.select("river_id", "time", r6("qlateral", "v"))


@query(sql(f"SELECT TIMESTAMP '{GRID_START}' + to_hours(CAST(t AS BIGINT)) AS time, x_index, y_index, round(CAST(CAST(ro AS FLOAT) AS DOUBLE), 4) AS ro FROM grid", "grid"))
def grid_netcdf(spark, d):
    """A runoff cube in two netCDF files (time, lat, lon), 32-bit, with coordinates; read as one by the places of its cells."""
    base, (x, y) = place(spark, "grid"), views.axes(spark, d)
    g = io.with_dates(views.grid(spark, d), GRID_START, HOUR).join(F.broadcast(x), "x_index").join(F.broadcast(y), "y_index")
    g = g.select("t", F.col("time").alias("valid_time"), F.col("y").alias("latitude"), F.col("x").alias("longitude"), "ro")
    for k in (0, 1):
        netcdf.write(g.where(F.col("t") % 2 == k), f"{base}-{k}.nc", {"valid_time": "time", "latitude": "double", "longitude": "double"}, {"ro": "float"}, about={"ro": {"units": "m"}})
    return io.read_grid(spark, [f"{base}-0.nc", f"{base}-1.nc"], "ro", "longitude", "latitude", "valid_time").withColumn("ro", F.round("ro", 4))


@query(_WEIGHTS)
def weights_netcdf(spark, d):
    path = f"{place(spark, 'weights')}.nc"
    io.write_weights(views.weights(spark, d), path, grid="derived")
    return io.read_weights(spark, path).withColumn("proportion", r6("proportion", "p"))


# --- routers over files -------------------------------------------------------------------------------------------------------------------


def series_file(df: DataFrame, path: str, value: str = "v") -> str:
    df.select("river_id", "time", F.col(value).alias("qlateral")).write.parquet(path)
    return path


_ROUTED = f"SELECT river_id, TIMESTAMP '{START}' + to_hours(CAST(t AS BIGINT)) AS time, round(CAST(CAST(q AS FLOAT) AS DOUBLE), 2) AS q"


@query(sql(f"{_ROUTED}, CAST(t AS BIGINT) * 3600 AS seconds FROM {_mean_sql('rapid')}", "net", "qlateral"))
def routed_by_command_line(spark, d):
    """A configuration file, the command line, and the default sink: 32-bit discharge in a file named after its input."""
    base = place(spark, "routed")
    series_file(views.qlateral(spark, d), f"{base}/input.parquet")
    options = {"_router": "RapidMuskingum", "params_file": params_of(spark, d), "qlateral_files": [f"{base}/input.parquet"], "discharge_dir": base, "log": False}
    with tempfile.TemporaryDirectory() as own:  # the driver's alone
        path = os.path.join(own, "run.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(options, f)
        if cli.main(["route", "--router", "RapidMuskingum", path], spark):
            raise RuntimeError("the command failed")
    out = spark.read.parquet(f"{base}/discharge_input.parquet")
    return out.select("river_id", "time", F.round(F.col("Q").cast("double"), 2).alias("q"), io.seconds_since(F.col("time"), START).alias("seconds"))


@query(sql(f"{_ROUTED} FROM {_mean_sql('rapid')}", "net", "qlateral"))
def routed_netcdf(spark, d):
    """A router from netCDF inflow to netCDF discharge."""
    base = place(spark, "netcdf")
    q = views.qlateral(spark, d).select("time", "river_id", F.col("v").alias("qlateral"))
    netcdf.write(q, f"{base}-input.nc", {"time": "time", "river_id": "long"}, {"qlateral": "double"})
    RapidMuskingum(spark, params_file=params_of(spark, d), qlateral_files=f"{base}-input.nc", discharge_files=[f"{base}-out.nc"], log=False).route()
    out = netcdf.read(spark, [f"{base}-out.nc"], "time timestamp_ntz, river_id long, Q double")
    return out.select("river_id", "time", F.round("Q", 2).alias("q"))


@query(sql(f"{_ROUTED} FROM {_mean_sql('rapid')}", "net", "qlateral"))
def routed_with_kept_network(spark, d):
    """Two runs of one network, which the first keeps and the second finds."""
    base, params = place(spark, "kept"), params_of(spark, d)
    source = series_file(views.qlateral(spark, d), f"{base}/input.parquet")
    for out in ("first", "second"):
        RapidMuskingum(spark, params_file=params, qlateral_files=source, discharge_files=[f"{base}/{out}"], network_cache_dir=f"{base}/cache", log=False).route()
    if [name for name, _, _ in cache.catalogue(f"{base}/cache")] != ["network"]:
        raise RuntimeError("one network was to be kept")
    return spark.read.parquet(f"{base}/second").select("river_id", "time", F.round(F.col("Q").cast("double"), 2).alias("q"))


@query(sql(f"SELECT river_id, TIMESTAMP '{START}' + to_hours(CAST(t AS BIGINT)) AS time, round(q, 2) AS q FROM {_mean_sql('rapid')} WHERE river_id IN (1, 5, 42) AND t >= 30 AND t < 300", "net", "qlateral"))
def discharge_store(spark, d):
    """Discharge clustered by watershed and river over 16 files; of these, the ones that hold three rivers on some days are opened."""
    base, net = place(spark, "store"), network.with_roots(views.net(spark, d))
    source = series_file(views.qlateral(spark, d), f"{base}/input.parquet")
    router = RapidMuskingum(spark, params_file=params_of(spark, d), qlateral_files=source, discharge_files=[f"{base}/out"], log=False)
    router.set_write_discharges(store.sink(net, 16)).route()
    start = datetime.fromisoformat(START)
    found = store.read(spark, f"{base}/out", net, [1, 5, 42], start + timedelta(hours=30), start + timedelta(hours=300))
    return found.select("river_id", "time", F.round("q", 2).alias("q"))


@query(sql(f"{_ROUTED} FROM {_mean_sql('rapid')} WHERE river_id <= 3", "net", "qlateral"))
def routed_in_sequence(spark, d):
    """Two inputs one after the other, the state carried on, with a sink that passes some rivers on and hooks of one's own."""

    class Counted(RapidMuskingum):
        calls = 0

        def before_route(self):
            self.calls += 1

        def after_route(self):
            self.calls += 1

    base, q = place(spark, "sequence"), views.qlateral(spark, d)
    inputs = [series_file(q.where("t < 24"), f"{base}/a.parquet"), series_file(q.where("t >= 24"), f"{base}/b.parquet")]
    router = Counted(spark, params_file=params_of(spark, d), qlateral_files=inputs, discharge_files=[f"{base}/qa", f"{base}/qb"], log=False)
    router.set_write_discharges(io.selected_rivers(io.write_discharge, [1, 2, 3])).route()
    if router.calls != 2:
        raise RuntimeError("a hook was not called once")
    return spark.read.parquet(f"{base}/qa", f"{base}/qb").select("river_id", "time", F.round(F.col("Q").cast("double"), 2).alias("q"))


@query(sql(f"SELECT CAST(river_id AS BIGINT) AS river_id, round(avg(full_), 6) AS q FROM {_MEMBERS} WHERE s = {H} - 1 GROUP BY 1", "net_members", "lateral_members"))
def routed_ensemble(spark, d):
    """A file for each member, all from one state and routed at once; the final state is their mean."""
    base, q = place(spark, "ensemble"), written(views.lateral_arrays_members(spark, d), "members", "member")
    members = sorted(r["member"] for r in q.select("member").distinct().collect())  # five event types
    inputs = [series_file(views.by_hour(q.where(F.col("member") == m)), f"{base}/in/{k}") for k, m in enumerate(members)]
    outputs = [f"{base}/out/{k}" for k in range(len(members))]
    RapidMuskingum(spark, params_file=params_of(spark, d), qlateral_files=inputs, discharge_files=outputs, runoff_processing_mode="ensemble", channel_state_final_file=f"{base}/state", log=False).route()
    return io.read_state(spark, f"{base}/state", views.net(spark, d)).select("river_id", r6("q", "q"))


@query(sql(f"{_ROUTED} FROM {_mean_sql('unit', 2, lateral=_UNIT)}", "net", "qlateral", "uh_inputs"))
def routed_unit_hydrographs(spark, d):
    """Depths and kernels from files, half-hour routing steps."""
    base = place(spark, "unit")
    series_file(_depths(spark, d), f"{base}/input.parquet")
    io.write_kernel(kernels.kernel(views.uh_inputs(spark, d), HOUR, "triangular"), f"{base}/kernel", HOUR)
    UnitMuskingum(spark, params_file=params_of(spark, d), qlateral_files=f"{base}/input.parquet", discharge_dir=base, uh_kernel_file=f"{base}/kernel", uh_state_final_file=f"{base}/carry", dt_routing=HOUR // 2, log=False).route()
    return spark.read.parquet(f"{base}/discharge_input.parquet").select("river_id", "time", F.round(F.col("Q").cast("double"), 2).alias("q"))


@query(sql("SELECT 'qlateral_' || strftime(min(time), '%Y%m%d%H') || '_' || strftime(max(time), '%Y%m%d%H') || '.parquet' AS suggested, 'out/discharge_a.parquet' AS output, CAST(3600 AS BIGINT) AS step FROM qlateral", "qlateral"))
def names_and_step(spark, d):
    """The name suggested for an input, the name of its output, and its step as told by its first two times."""
    times = written(views.qlateral(spark, d).select("time").distinct(), "times")
    first, last = times.agg(F.min("time"), F.max("time")).first()
    return spark.createDataFrame([(io.suggested_name(first, last), io.discharge_names(["in/a.parquet"], "out")[0], first_step(times, first))], "suggested string, output string, step long")


@query(
    """SELECT 'discharge_files' AS option, 's3://b/discharge_' || lower(r_name) || '.parquet' AS value FROM region
    UNION ALL SELECT * FROM (VALUES ('dt_routing', '900'), ('log_level', 'DEBUG'), ('progress_bar', 'False'), ('grid_runoff_files', '[]'), ('strategy', 'auto')) v(option, value)"""
)
def configuration(spark, d):
    """Options from a file with others over them, defaults for the rest, and an output for each input (one a region)."""
    inputs = [f"s3://b/{r['r_name'].lower()}.parquet" for r in views.table(spark, d, "region", "r_name").collect()]  # five
    with tempfile.TemporaryDirectory() as own:
        path = os.path.join(own, "run.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"params_file": "s3://b/params", "qlateral_files": inputs, "discharge_dir": "s3://b", "grid_runoff_files": None, "log": False, "dt_routing": 60}, f)
        cfg = Config.load(path, dt_routing=900, log_level="DEBUG")
    shown = [(n, str(getattr(cfg, n))) for n in ("dt_routing", "log_level", "progress_bar", "grid_runoff_files", "strategy")]
    return spark.createDataFrame([*shown, *(("discharge_files", x) for x in cfg.discharge_files)], "option string, value string")


@query(sql(f"SELECT river_id, CAST(t AS INT) AS t, round(q, 6) AS q FROM {_CONV} WHERE t < {H}", "uh_inputs", "qlateral"))
def stream_convolution(spark, d):
    """Unit hydrographs over a stream of files, the carry-over as state."""
    base, lateral = place(spark, "stream"), _depths(spark, d).select("river_id", "t", "v")
    half = views.hours(spark, d) // 2
    for name, rows in (("1", lateral.where(F.col("t") < half)), ("2", lateral.where(F.col("t") >= half))):
        rows.coalesce(1).write.parquet(f"{base}/in/{name}")
    own = written(_kernels(spark, d), "stream-kernels")
    stream = spark.readStream.schema(lateral.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    save = lambda df, batch: df.write.parquet(f"{base}/out/{batch}")
    convolved(stream, own).writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/*").select("river_id", "t", r6("q", "q"))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid')}", "net", "qlateral"))
def stream_route(spark, d):
    """Rapid routing over a stream of three files, the flows of each watershed as state."""
    base, lateral = place(spark, "stream"), written(views.qlateral(spark, d).select("river_id", "t", "v"), "stream-series")
    third = views.hours(spark, d) // 3
    for k in range(3):
        # A batch is a file. The rows are found by many tasks; only the file is written by one.
        lateral.where((F.col("t") >= k * third) & ((F.col("t") < (k + 1) * third) | F.lit(k == 2))).repartition(1).write.parquet(f"{base}/in/{k}")
    stream = spark.readStream.schema(lateral.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    save = lambda df, batch: df.write.parquet(f"{base}/out/{batch}")
    routed(stream, views.net(spark, d), "rapid", HOUR).writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/*").select("river_id", "t", r6("q", "q"))
