"""The query catalogue: every query over the derived views, with the SQL that checks it.

Doubles are rounded to six places on both sides, so that sums taken in another order agree.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry, kernels, metrics
from thalweg.operators import network, routing, runoff, validate, weights
from thalweg.session import written
from thalweg.sources import io, views
from thalweg.sources.views import START, sql

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str]] = {}
HOUR = 3600
#: Hours of channel routing, which has no input series, and the length of the hourly series in SQL.
CHANNEL_HOURS, H = 72, "(SELECT n FROM horizon)"
TARGET = 5
GRID_START = "1995-01-01 00:00:00"


def query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        ENTRIES[f.__name__] = (f, oracle)
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6).alias(name)


# --- scans, network -------------------------------------------------------------------------------------------------------------------------


@query(sql("SELECT river_id, downstream_river_id, k, x FROM net", "net"))
def scan_network(spark, d):
    return views.net(spark, d)


@query(sql("SELECT DISTINCT x_index, y_index FROM weights", "weights"))
def cells_needed(spark, d):
    return runoff.cells_needed(views.weights(spark, d))


@query(sql("SELECT river_id FROM net WHERE river_id NOT IN (SELECT downstream_river_id FROM net)", "net"))
def headwaters(spark, d):
    return network.headwaters(views.net(spark, d)).select("river_id")


@query(sql("SELECT river_id FROM net WHERE downstream_river_id < 0", "net"))
def outlets(spark, d):
    return network.outlets(views.net(spark, d)).select("river_id")


@query(sql("SELECT n.river_id, count(u.river_id) AS n_upstream FROM net n LEFT JOIN net u ON u.downstream_river_id = n.river_id GROUP BY 1", "net"))
def indegree(spark, d):
    return network.in_degree(views.net(spark, d))


@query(sql("SELECT downstream_river_id AS downstream, river_id AS upstream FROM net WHERE downstream_river_id >= 0", "net"))
def adjacency(spark, d):
    return network.adjacency(views.net(spark, d))


@query(sql("SELECT river_id AS src, downstream_river_id AS dst FROM net", "net"))
def digraph(spark, d):
    return network.digraph(views.net(spark, d))


@query(sql("SELECT river_id, count(*) AS n FROM bad_net GROUP BY 1 HAVING count(*) > 1", "bad_net"))
def duplicate_ids(spark, d):
    return network.duplicate_ids(views.bad_net(spark, d))


@query(sql("SELECT river_id, downstream_river_id FROM bad_net WHERE downstream_river_id >= 0 AND downstream_river_id NOT IN (SELECT river_id FROM bad_net)", "bad_net"))
def unknown_downstream(spark, d):
    return network.unknown_downstream(views.bad_net(spark, d))


@query(sql("SELECT DISTINCT a.river_id, a.downstream_river_id FROM bad_net a JOIN bad_net b ON a.downstream_river_id = b.river_id WHERE b.position <= a.position", "bad_net"))
def topo_violations(spark, d):
    return network.order_violations(views.bad_net(spark, d))


_BAD = """SELECT rule, river_id FROM (
    SELECT 'repeated id' AS rule, river_id FROM (SELECT river_id FROM bad_net GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unknown downstream id', river_id FROM bad_net WHERE downstream_river_id >= 0 AND downstream_river_id NOT IN (SELECT river_id FROM bad_net)
    UNION ALL SELECT 'k not positive', river_id FROM bad_net WHERE k <= 0
    UNION ALL SELECT 'x outside 0 to 0.5', river_id FROM bad_net WHERE x < 0 OR x > 0.5
    UNION ALL SELECT DISTINCT 'not before its downstream river', a.river_id FROM bad_net a JOIN bad_net b ON a.downstream_river_id = b.river_id WHERE b.position <= a.position)"""


@query(sql(_BAD, "bad_net"))
def params_violations(spark, d):
    return validate.params(views.bad_net(spark, d))


@query(
    sql(
        """SELECT 'river not in the network' AS rule, river_id FROM weights WHERE river_id % 10 = 0 AND x_index <> 3
        UNION ALL SELECT 'proportions do not sum to 1', river_id FROM weights WHERE x_index <> 3 GROUP BY river_id HAVING abs(sum(proportion) - 1) > 0.000001""",
        "weights",
    )
)
def weights_violations(spark, d):
    """Weights that lost the cells of one column, against a network that lost every tenth river."""
    return validate.weights(views.weights(spark, d).where("x_index <> 3"), views.net(spark, d).where("river_id % 10 <> 0"))


@query(sql("SELECT 'negative state' AS rule, river_id FROM state WHERE river_id % 9 = 4 UNION ALL SELECT 'river without a state', river_id FROM net WHERE river_id % 9 = 5", "state"))
def state_violations(spark, d):
    s = views.state(spark, d).where("river_id % 9 <> 5").withColumn("q", F.when(F.col("river_id") % 9 == 4, -F.col("q")).otherwise(F.col("q")))
    return validate.channel_state(s, views.net(spark, d))


@query(sql("SELECT n.river_id, k, x, ds_river_id AS downstream_river_id FROM net n JOIN connectivity c ON n.river_id = c.river_id", "connectivity"))
def merge_connectivity_inner(spark, d):
    return network.with_connectivity(views.net(spark, d), views.connectivity(spark, d), "inner")


@query(sql("SELECT n.river_id, k, x, ds_river_id AS downstream_river_id FROM net n LEFT JOIN connectivity c ON n.river_id = c.river_id", "connectivity"))
def merge_connectivity_left(spark, d):
    return network.with_connectivity(views.net(spark, d), views.connectivity(spark, d), "left")


@query(sql("SELECT river_id, watershed_id, dist FROM roots", "net", "roots"))
def rooted_network(spark, d):
    return network.rooted(views.net(spark, d))


@query(sql("SELECT watershed_id, count(*) AS n_rivers, max(dist) AS depth FROM roots GROUP BY 1", "net", "roots"))
def watershed_summary(spark, d):
    return network.watersheds(views.net(spark, d))


@query(sql("SELECT river_id, (SELECT max(dist) FROM roots) - dist AS level FROM roots", "net", "roots"))
def river_level(spark, d):
    return network.levels(views.net(spark, d))


@query(
    sql(
        """SELECT river_id, CAST(max(s) AS INT) AS strahler FROM (
        SELECT river_id, s FROM (
            WITH RECURSIVE o(level, m) AS (
                SELECT (SELECT max(dist) FROM roots) + 1, MAP {}::MAP(BIGINT, INT)
                UNION ALL
                SELECT level - 1, map_concat(m, (SELECT map(list(q.river_id), list(q.s)) FROM (
                    SELECT r.river_id, coalesce((SELECT max(t.st) + CASE WHEN count(*) FILTER (WHERE t.st = t.top) > 1 THEN 1 ELSE 0 END
                        FROM (SELECT o.m[n.river_id] AS st, max(o.m[n.river_id]) OVER () AS top FROM net n WHERE n.downstream_river_id = r.river_id) t), 1)::INT AS s
                    FROM roots r WHERE r.dist = o.level - 1) q))
                FROM o WHERE level > 0)
            SELECT unnest(map_keys(m)) AS river_id, unnest(map_values(m)) AS s FROM o WHERE level = 0)) GROUP BY 1""",
        "net",
        "roots",
    )
)
def strahler_order(spark, d):
    return network.strahler(views.net(spark, d))


_UP = f"up(river_id) AS (SELECT CAST({TARGET} AS BIGINT) UNION ALL SELECT n.river_id FROM net n JOIN up u ON n.downstream_river_id = u.river_id)"


@query(sql(f"SELECT n.river_id, CASE WHEN n.river_id = {TARGET} THEN -1 ELSE downstream_river_id END AS downstream_river_id, k, x FROM net n WHERE n.river_id IN (WITH RECURSIVE {_UP} SELECT river_id FROM up)", "net"))
def upstream_subset(spark, d):
    return network.subset(views.net(spark, d), TARGET)[0]


@query(sql(f"SELECT river_id, x_index, y_index, x, y, area_sqm, round(proportion, 6) AS proportion FROM weights WHERE river_id IN (WITH RECURSIVE {_UP} SELECT river_id FROM up)", "weights"))
def weights_subset(spark, d):
    return network.subset(views.net(spark, d), TARGET, views.weights(spark, d))[1].withColumn("proportion", r6("proportion", "p"))


@query(sql("SELECT q.river_id, q.t, round(coalesce(i.s, 0), 6) AS inflow FROM qlateral q LEFT JOIN (SELECT n.downstream_river_id AS river_id, t, sum(v) AS s FROM net n JOIN qlateral USING (river_id) GROUP BY 1, 2) i ON i.river_id = q.river_id AND i.t = q.t", "net", "qlateral"))
def upstream_inflow(spark, d):
    return network.inflow(views.net(spark, d), views.qlateral(spark, d).withColumnRenamed("v", "q")).select("river_id", "t", r6("inflow", "inflow"))


# --- grid weights ---------------------------------------------------------------------------------------------------------------------------


@query(sql("SELECT river_id, x_index, y_index, x, y, area_sqm, round(proportion, 6) AS proportion FROM weights", "weights"))
def grid_weights_proportion(spark, d):
    return views.weights(spark, d).withColumn("proportion", r6("proportion", "p"))


@query(sql("SELECT river_id, sum(area_sqm) AS area_sqm FROM weights GROUP BY 1", "weights"))
def catchment_area(spark, d):
    return views.weights(spark, d).groupBy("river_id").agg(F.sum("area_sqm").alias("area_sqm"))


@query(sql("SELECT row_number() OVER (ORDER BY -river_id, area_sqm DESC, x_index, y_index) AS row, river_id, x_index, y_index FROM weights", "weights"))
def weights_topo_sorted(spark, d):
    order = views.net(spark, d).select("river_id", (-F.col("river_id")).alias("position"))
    placed = weights.in_network_order(views.weights(spark, d), order)
    return weights.numbered(placed, "position", F.desc("area_sqm"), "x_index", "y_index").select("row", "river_id", "x_index", "y_index")


_BOUNDS = """bx AS (SELECT x_index, coalesce((lag(x) OVER o + x) / 2, x - 330) AS x_min, coalesce((lead(x) OVER o + x) / 2, x + 330) AS x_max
    FROM (SELECT CAST(i AS INT) AS x_index, CASE WHEN i * 30 > 180 THEN i * 30 - 360 ELSE i * 30 END::DOUBLE AS x FROM (SELECT DISTINCT p_partkey % 12 AS i FROM part)) WINDOW o AS (ORDER BY x)),
    by_ AS (SELECT y_index, coalesce((lag(y) OVER o + y) / 2, y - 330) AS y_min, coalesce((lead(y) OVER o + y) / 2, y + 330) AS y_max
    FROM (SELECT CAST(i AS INT) AS y_index, (i * 15 - 60)::DOUBLE AS y FROM (SELECT DISTINCT s_suppkey % 9 AS i FROM supplier)) WINDOW o AS (ORDER BY y)),
    cells AS (SELECT x_index, y_index, x_min, x_max, y_min, y_max, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM bx CROSS JOIN by_)"""


@query(f"WITH {_BOUNDS} SELECT * FROM cells")
def regular_grid_cells(spark, d):
    return weights.cells(*views.axes(spark, d)).select("x_index", "y_index", "x_min", "x_max", "y_min", "y_max", "x", "y")


@query("SELECT CAST(i AS INT) AS x_index, CASE WHEN i * 30 > 180 THEN i * 30 - 360 ELSE i * 30 END::DOUBLE AS x, row_number() OVER (ORDER BY CASE WHEN i * 30 > 180 THEN i * 30 - 360 ELSE i * 30 END) AS place FROM (SELECT DISTINCT p_partkey % 12 AS i FROM part)")
def lon_wrap_index(spark, d):
    from pyspark.sql import Window as W

    x = views.axes(spark, d)[0].withColumn("x", weights.wrapped(F.col("x")))
    return x.select("x_index", "x", F.row_number().over(W.orderBy("x")).cast("long").alias("place"))


_E = geometry.ECCENTRICITY
_Y = f"({geometry.AXIS} * (1 - {_E}::DOUBLE * {_E}::DOUBLE) / 2 * (sin(radians(Z)) / (1 - pow({_E}::DOUBLE * sin(radians(Z)), 2)) + atanh({_E}::DOUBLE * sin(radians(Z))) / {_E}::DOUBLE))"


@query(
    f"""WITH {_BOUNDS}, b AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS river_id, n_nationkey * 11.0::DOUBLE - 140 AS x0, n_nationkey * 4.0::DOUBLE - 50 AS y0 FROM nation),
    i AS (SELECT river_id, x_index, y_index, greatest(x_min, x0) AS a, least(x_max, x0 + 20) AS c, greatest(y_min, y0) AS s, least(y_max, y0 + 12) AS n FROM b JOIN cells ON x_min < x0 + 20 AND x_max > x0 AND y_min < y0 + 12 AND y_max > y0),
    m AS (SELECT river_id, x_index, y_index, {geometry.AXIS} * radians(c - a) * ({_Y.replace("Z", "n")} - {_Y.replace("Z", "s")}) AS area FROM i)
    SELECT river_id, x_index, y_index, round(area / 1000000, 3) AS area_sqkm, round(area / sum(area) OVER (PARTITION BY river_id), 6) AS proportion FROM m"""
)
def voronoi_overlay_area(spark, d):
    w = weights.overlay(weights.cells(*views.axes(spark, d)), views.boxes(spark, d))
    return w.select("river_id", "x_index", "y_index", F.round(F.col("area_sqm") / 1_000_000, 3).alias("area_sqkm"), r6("proportion", "proportion"))


#: Corners of what a cell (a to c, s to n) has of a triangle below its slanted side: F is the side's height at X, G the X at a height.
_CORNERS = "[{'x': a, 'y': s}, {'x': least(c, gs), 'y': s}, {'x': least(c, gs), 'y': least(n, greatest(s, fc))}, {'x': gn, 'y': least(n, y0 + h * (1 - (gn - x0) / w))}, {'x': a, 'y': least(n, fa)}]"


@query(
    f"""WITH t AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS river_id, sign, n_nationkey * 9.0::DOUBLE - 120 + p AS x0, n_nationkey * 3.0::DOUBLE - 50 + q AS y0, w, h
        FROM nation CROSS JOIN (VALUES (1, 0, 0, 30.0::DOUBLE, 14.0::DOUBLE), (-1, 3, 2, 9.0::DOUBLE, 4.0::DOUBLE)) v(sign, p, q, w, h)),
    g AS (SELECT CAST(i AS INT) AS x_index, CAST(j AS INT) AS y_index, CASE WHEN i * 1.5 > 180 THEN i * 1.5 - 360 ELSE i * 1.5 END::DOUBLE - 0.75 AS x1, j::DOUBLE - 60.5 AS y1 FROM range(240) a(i) CROSS JOIN range(121) b(j)),
    o AS (SELECT *, greatest(x1, x0) AS a, least(x1 + 1.5, x0 + w) AS c, greatest(y1, y0) AS s, least(y1 + 1, y0 + h) AS n FROM t JOIN g ON x1 < x0 + w AND x1 + 1.5 > x0 AND y1 < y0 + h AND y1 + 1 > y0),
    f AS (SELECT *, y0 + h * (1 - (a - x0) / w) AS fa, y0 + h * (1 - (c - x0) / w) AS fc, x0 + w * (1 - (s - y0) / h) AS gs, greatest(a, least(c, x0 + w * (1 - (n - y0) / h))) AS gn FROM o WHERE y0 + h * (1 - (a - x0) / w) > s),
    e AS (SELECT river_id, sign, x_index, y_index, unnest({_CORNERS}) AS p, generate_subscripts({_CORNERS}, 1) AS k FROM f),
    m AS (SELECT river_id, sign, x_index, y_index, k, {geometry.AXIS} * radians(p.x) AS x, {_Y.replace("Z", "p.y")} AS y FROM e),
    r AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, first_value(x) OVER w AS x3, first_value(y) OVER w AS y3 FROM m WINDOW w AS (PARTITION BY river_id, sign, x_index, y_index ORDER BY k)),
    z AS (SELECT river_id, x_index, y_index, sum(sign * (x * coalesce(y2, y3) - coalesce(x2, x3) * y)) / 2 AS area FROM r GROUP BY 1, 2, 3)
    SELECT river_id, x_index, y_index, round(area / 1000000, 3) AS area_sqkm, round(area / sum(area) OVER (PARTITION BY river_id), 6) AS proportion FROM z WHERE area > 1000"""
)
def slanted_overlay_area(spark, d):
    """Triangles with triangular holes over a grid of one degree and a half by one: cells inside, and cells that slanted sides cut."""
    x = spark.range(240).select(F.col("id").cast("int").alias("x_index"), (F.col("id") * 1.5).alias("x"))
    y = spark.range(121).select(F.col("id").cast("int").alias("y_index"), (F.col("id") - 60.0).alias("y"))
    w = weights.overlay(weights.cells(x, y), views.slanted_catchments(spark, d)).where("area_sqm > 1000")
    return w.select("river_id", "x_index", "y_index", F.round(F.col("area_sqm") / 1_000_000, 3).alias("area_sqkm"), r6("proportion", "proportion"))


# --- runoff ---------------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT unit, CASE WHEN unit IN ('mm', 'millimeters') THEN 0.001 ELSE 1.0 END::DOUBLE AS factor, round(sum(CAST(l_quantity AS DOUBLE)) * CASE WHEN unit IN ('mm', 'millimeters') THEN 0.001 ELSE 1.0 END, 6)::DOUBLE AS depth
    FROM (SELECT ['m', 'meters', 'kg m-2', 'mm', 'millimeters', NULL][l_orderkey % 6 + 1] AS unit, l_quantity FROM lineitem) GROUP BY unit"""
)
def unit_conversion(spark, d):
    """Depths in every known unit, and without one, as metres."""
    units = F.array(*map(F.lit, runoff.UNITS), F.lit(None))
    df = views.table(spark, d, "lineitem", "l_orderkey", "l_quantity").select(F.get(units, (F.col("l_orderkey") % 6).cast("int")).alias("unit"), "l_quantity")
    df = df.withColumn("factor", runoff.unit_factor_column(F.col("unit"))).groupBy("unit", "factor").agg(F.sum(F.col("l_quantity").cast("double")).alias("depth"))
    return df.select("unit", "factor", r6(F.col("depth") * F.col("factor"), "depth"))


_DEPTH = "SELECT w.river_id, g.t, sum(g.ro * w.proportion) AS v FROM grid g JOIN weights w ON g.x_index = w.x_index AND g.y_index = w.y_index GROUP BY 1, 2"


@query(sql(f"SELECT river_id, t, round(v, 6) AS v FROM ({_DEPTH})", "grid", "weights"))
def runoff_to_qlateral_depth(spark, d):
    return runoff.to_qlateral(views.grid(spark, d), views.weights(spark, d)).withColumn("v", r6("v", "v"))


@query(sql(f"SELECT river_id, t, round(v * 0.001 * a, 6) AS v FROM ({_DEPTH}) JOIN (SELECT river_id, sum(area_sqm) AS a FROM weights GROUP BY 1) USING (river_id)", "grid", "weights"))
def runoff_to_qlateral_volume(spark, d):
    return runoff.to_qlateral(views.grid(spark, d), views.weights(spark, d), unit="mm", volumes=True).withColumn("v", r6("v", "v"))


_DIFF = f"SELECT river_id, t, v - coalesce(lag(v) OVER (PARTITION BY river_id ORDER BY t), 0) AS v FROM ({_DEPTH})"


@query(sql(f"SELECT river_id, t, round(v, 6) + 0.0 AS v FROM ({_DIFF})", "grid", "weights"))
def cumulative_to_incremental(spark, d):
    return runoff.to_incremental(runoff.aggregate(views.grid(spark, d), views.weights(spark, d))).withColumn("v", r6("v", "v") + 0.0)


@query(sql(f"SELECT river_id, t, round(greatest(v, 0), 6) AS v FROM ({_DIFF})", "grid", "weights"))
def qlateral_force_positive(spark, d):
    return runoff.to_qlateral(views.grid(spark, d), views.weights(spark, d), cumulative=True, force_positive=True).withColumn("v", r6("v", "v"))


@query(sql(f"SELECT river_id, t, round(sum(v) OVER (PARTITION BY river_id ORDER BY t), 6) AS v FROM ({_DEPTH})", "grid", "weights"))
def incremental_to_cumulative(spark, d):
    return runoff.to_cumulative(runoff.aggregate(views.grid(spark, d), views.weights(spark, d))).withColumn("v", r6("v", "v"))


_GAPPY = _DEPTH.replace("FROM grid g", "FROM gappy g")


@query(sql(f"SELECT river_id, t, round(CASE WHEN isnan(v) THEN 0 ELSE v END, 6) AS v FROM ({_GAPPY})", "gappy", "weights"))
def nan_fill(spark, d):
    return runoff.to_qlateral(views.gappy_grid(spark, d), views.weights(spark, d)).withColumn("v", r6("v", "v"))


@query(
    sql(
        f"""SELECT river_id, t, round(v - coalesce(lag(v) OVER (PARTITION BY river_id ORDER BY t), 0), 8) + 0.0 AS v FROM (
        SELECT river_id, t, CASE WHEN t0 = t1 THEN v0 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM (
        SELECT river_id, t, last_value(c IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
               first_value(c IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM (
        SELECT g.river_id, g.t, c.c FROM (SELECT river_id, unnest(range(lo, hi + 1)) AS t FROM (SELECT river_id, min(t) AS lo, max(t) AS hi FROM d GROUP BY 1)) g LEFT JOIN
            (SELECT river_id, t, CASE WHEN isnan(v) THEN NULL ELSE sum(CASE WHEN isnan(v) THEN 0 ELSE v END) OVER (PARTITION BY river_id ORDER BY t) END AS c FROM d) c ON c.river_id = g.river_id AND c.t = g.t)
        WINDOW b AS (PARTITION BY river_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY river_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))""".replace("FROM d", f"FROM ({_GAPPY})"),
        "gappy",
        "weights",
    )
)
def resample_uniform(spark, d):
    g = views.gappy_grid(spark, d).withColumn("t", F.col("t").cast("long"))
    return runoff.to_qlateral(g, views.weights(spark, d), uniform=True).select("river_id", "t", (F.round("v", 8) + 0.0).alias("v"))


# --- unit hydrographs -----------------------------------------------------------------------------------------------------------------------


def _kernel_sql(shape: str) -> str:
    table = kernels.TABLES[shape]
    parts, last = kernels.ramps(table), table[0][-1]
    total = sum(p[2] for p in parts)
    volume = lambda z: "(" + " + ".join(f"{v!r}::DOUBLE / {w!r}::DOUBLE * least(greatest({z} - {s!r}::DOUBLE, 0), {w!r}::DOUBLE)" for s, w, v in parts) + ")"
    return f"""(SELECT river_id, CAST(i AS INT) AS step, (hi - lo) * area / {total!r}::DOUBLE / {HOUR} AS u FROM (
        SELECT river_id, i, area, {volume("z0")} AS lo, {volume("z1")} AS hi FROM (
        SELECT river_id, area, i, least(i * {HOUR}, {last!r}::DOUBLE * tp) / tp AS z0, least((i + 1) * {HOUR}, {last!r}::DOUBLE * tp) / tp AS z1
        FROM (SELECT river_id, area, 0.6::DOUBLE * tc + {HOUR / 2!r} AS tp FROM uh_inputs) CROSS JOIN range(CAST((SELECT ceil({last!r}::DOUBLE * max(0.6::DOUBLE * tc + {HOUR / 2!r}) / {HOUR}) FROM uh_inputs) AS BIGINT)) r(i))))"""


@query(sql(f"SELECT river_id, step, round(u, 6) AS u FROM {_kernel_sql('triangular')}", "uh_inputs"))
def uh_kernel_triangular(spark, d):
    return kernels.kernel(views.uh_inputs(spark, d), HOUR, "triangular").withColumn("u", r6("u", "u"))


@query(sql(f"SELECT river_id, step, round(u, 6) AS u FROM {_kernel_sql('curvilinear')}", "uh_inputs"))
def uh_kernel_curvilinear(spark, d):
    return kernels.kernel(views.uh_inputs(spark, d), HOUR).withColumn("u", r6("u", "u"))


def _kernels(spark, d):
    return kernels.packed(kernels.kernel(views.uh_inputs(spark, d), HOUR, "triangular"), "step", "u", "kernel")


def _depths(spark, d):
    """Lateral depths: the inflow scaled to millimetres."""
    return views.qlateral(spark, d).withColumn("v", F.col("v") / 100_000)


_CONV = f"(SELECT q.river_id, q.t + k.step AS t, sum(q.v / 100000 * k.u) AS q FROM qlateral q JOIN {_kernel_sql('triangular')} k ON k.river_id = q.river_id GROUP BY 1, 2)"


@query(sql(f"SELECT river_id, CAST(t AS INT) AS t, round(q, 6) AS q FROM {_CONV} WHERE t < {H}", "uh_inputs", "qlateral"))
def uh_convolve(spark, d):
    out = kernels.convolve(kernels.packed(_depths(spark, d), "t", "v", "v"), _kernels(spark, d))
    return out.select("river_id", F.posexplode("v").alias("t", "q")).withColumn("q", r6("q", "q"))


@query(sql(f"SELECT river_id, CAST(t AS INT) AS t, round(q, 6) AS q FROM {_CONV} WHERE t < {H}", "uh_inputs", "qlateral"))
def uh_convolve_incremental(spark, d):
    out = kernels.convolve_incrementally(kernels.packed(_depths(spark, d), "t", "v", "v"), _kernels(spark, d))
    return out.select("river_id", F.posexplode("v").alias("t", "q")).withColumn("q", r6("q", "q"))


@query(sql(f"SELECT river_id, CAST(t - {H} AS INT) AS step, round(q, 6) AS carry FROM {_CONV} WHERE t >= {H}", "uh_inputs", "qlateral"))
def uh_final_state(spark, d):
    out = kernels.convolve(kernels.packed(_depths(spark, d), "t", "v", "v"), _kernels(spark, d))
    carry = F.slice("state", F.lit(1), F.size("state") - 1)  # the last place is always 0
    return out.select("river_id", F.posexplode(carry).alias("step", "carry")).withColumn("carry", r6("carry", "carry"))


@query(sql(f"SELECT river_id, CAST(t AS INT) AS t, round(q, 6) AS q FROM {_CONV} WHERE t < {H}", "uh_inputs", "qlateral"))
def uh_convolve_blocks(spark, d):
    """Blocks of four days convolved in the frequency domain, each with the end of the block before it."""
    return kernels.by_step(kernels.convolve_blocks(_depths(spark, d), _kernels(spark, d), block=96)).select("river_id", "t", r6("v", "q"))


@query(sql(f"SELECT river_id, CAST(t - {H} AS INT) AS step, round(q, 6) AS carry FROM {_CONV} WHERE t >= {H}", "uh_inputs", "qlateral"))
def uh_final_state_blocks(spark, d):
    """The carry-over of two inputs, the second begun from the first's."""
    half, own, rows = views.hours(spark, d) // 2, written(_kernels(spark, d), "kernels"), _depths(spark, d)
    first = kernels.convolve_blocks(rows.where(F.col("t") < half), own).where("state IS NOT NULL").select("river_id", "state")
    rest = kernels.convolve_blocks(rows.where(F.col("t") >= half).withColumn("t", F.col("t") - half), own, first).where("state IS NOT NULL")
    carry = F.slice("state", F.lit(1), F.size("state") - 1)  # the last place is always 0
    return rest.select("river_id", F.posexplode(carry).alias("step", "carry")).withColumn("carry", r6("carry", "carry"))


# --- routing --------------------------------------------------------------------------------------------------------------------------------

_C = lambda dt, net="net": f"(SELECT river_id, downstream_river_id, ({dt} / k - 2 * x) / ({dt} / k + 2 * (1 - x)) AS c1, ({dt} / k + 2 * x) / ({dt} / k + 2 * (1 - x)) AS c2, (2 * (1 - x) - {dt} / k) / ({dt} / k + 2 * (1 - x)) AS c3 FROM {net})"


@query(sql(f"SELECT river_id, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c1 + c2, 6) AS c4 FROM {_C('900.0::DOUBLE')}", "net"))
def muskingum_coefficients(spark, d):
    c = routing.coefficients(views.net(spark, d), 900)
    return c.select("river_id", *(r6(n, n) for n in ("c1", "c2", "c3", "c4")))


def _solver_sql(kind: str, substeps: int = 1, lateral: str = "SELECT river_id, t, v FROM qlateral", start: str = "0.0::DOUBLE", hours: int | str = H, net: str = "net") -> str:
    """river_id, s (from 0), full_: flows by substep. A recursion over substeps holds the flows of all rivers as a list; within a substep they
    are found from the largest id down, as a river's id is smaller than those upstream. Index i of a list is river n + 1 - i."""
    dt = f"{HOUR / substeps}::DOUBLE"
    order = "ORDER BY river_id DESC"
    lat = "lat[i]" if kind != "channel" else "0.0::DOUBLE"
    inflow_now = "coalesce(list_sum(list_transform(ups[i], lambda j: acc[j])), 0.0)"
    own = "list_sum(list_transform(ups[i], lambda j: CASE WHEN len(ups[j]) = 0 THEN lat[j] ELSE q[j] END))" if kind == "unit" else "list_sum(list_transform(ups[i], lambda j: q[j]))"
    source = f" + (c1[i] + c2[i]) / {HOUR}.0::DOUBLE * {lat}" if kind == "rapid" else ""
    x_now = f"c1[i] * {inflow_now} + c2[i] * coalesce({own}, 0.0) + c3[i] * x[i]{source}"
    full = f"CASE WHEN len(ups[i]) = 0 THEN {lat} ELSE {x_now} + {lat} END" if kind == "unit" else x_now
    series = f"SELECT t, list(v {order}) AS lat FROM ({lateral}) GROUP BY 1" if kind != "channel" else "SELECT 0 AS t, []::DOUBLE[] AS lat"
    return f"""(WITH RECURSIVE
        k AS (SELECT count(*) AS n, list(c1 {order}) AS c1, list(c2 {order}) AS c2, list(c3 {order}) AS c3 FROM {_C(dt, net)}),
        u AS (SELECT list(up ORDER BY river_id DESC) AS ups FROM (SELECT n.river_id, coalesce(list((SELECT count(*) FROM {net}) + 1 - m.river_id ORDER BY m.river_id DESC) FILTER (WHERE m.river_id IS NOT NULL), [])::BIGINT[] AS up FROM {net} n LEFT JOIN {net} m ON m.downstream_river_id = n.river_id GROUP BY 1)),
        l AS MATERIALIZED ({series}),
        z AS (SELECT list(q0 {order}) AS q0 FROM (SELECT river_id, {start} AS q0 FROM {net})),
        ending AS (SELECT {hours} * {substeps} - 1 AS last_s),
        r(s, q, x) AS (
            SELECT CAST(-1 AS BIGINT), q0, q0 FROM z
            UNION ALL
            SELECT s + 1, f, {"list_transform(range(1, n + 1), lambda i: CASE WHEN len(ups[i]) = 0 THEN 0.0::DOUBLE ELSE f[i] - lat[i] END)" if kind == "unit" else "f"} FROM (
                SELECT r.s, k.n, u.ups, l.lat, list_reduce(range(1, k.n + 1), lambda acc, i: list_append(acc, {full}), []::DOUBLE[]) AS f
                FROM r, k, u, l, ending WHERE r.s < ending.last_s{"" if kind == "channel" else f" AND l.t = (r.s + 1) // {substeps}"}))
        SELECT (SELECT n FROM k) + 1 - i AS river_id, s, q[i] AS full_ FROM r, range(1, (SELECT n FROM k) + 1) g(i) WHERE s >= 0)"""


def _mean_sql(kind: str, substeps: int = 1, **more: str) -> str:
    return f"(SELECT river_id, CAST(s // {substeps} AS INT) AS t, greatest(avg(full_), 0) AS q FROM {_solver_sql(kind, substeps, **more)} GROUP BY 1, 2)"


def _few(spark, d, steps: int) -> int:
    """Numbers of a task that let a piece have an eighth of the rivers, so that watersheds are cut."""
    return max(1, views.net(spark, d).count() // 8) * steps


def _series(routed: DataFrame, *keys: str) -> DataFrame:
    return routing.long_series(routed, *keys).withColumn("q", r6("q", "q"))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('channel', 2, start='CAST(10 + river_id % 7 AS DOUBLE)', hours=CHANNEL_HOURS)}", "net", "qlateral"))
def muskingum_route(spark, d):
    return _series(routing.route("channel", views.net(spark, d), None, CHANNEL_HOURS, HOUR, 2, views.state(spark, d)))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('channel', 2, start='CAST(10 + river_id % 7 AS DOUBLE)', hours=CHANNEL_HOURS)}", "net", "qlateral"))
def muskingum_route_levels(spark, d):
    return _series(routing.route("channel", views.net(spark, d), None, CHANNEL_HOURS, HOUR, 2, views.state(spark, d), strategy="levels", task_numbers=_few(spark, d, 2 * CHANNEL_HOURS)))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid')}", "net", "qlateral"))
def rapid_route(spark, d):
    return _series(routing.route("rapid", views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d), HOUR))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid')}", "net", "qlateral"))
def rapid_route_levels(spark, d):
    return _series(routing.route("rapid", views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d), HOUR, strategy="levels", task_numbers=_few(spark, d, views.hours(spark, d))))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid')}", "net", "qlateral"))
def rapid_route_chunks(spark, d):
    """Days routed side by side: maps of flows over a day are composed, and no task holds more than a day of a watershed."""
    found = routing.route_chunks("rapid", views.net(spark, d), views.qlateral(spark, d), 1, HOUR, views.hours(spark, d), 24)
    return found.select("river_id", F.posexplode("discharge").alias("p", "q"), "first").select("river_id", (F.col("first") + F.col("p")).alias("t"), r6("q", "q"))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid', 2)}", "net", "qlateral"))
def rapid_route_substeps(spark, d):
    return _series(routing.route("rapid", views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d), HOUR, 2))


_UNIT = f"SELECT river_id, t, q AS v FROM {_CONV} WHERE t < {H}"


def _unit_lateral(spark, d):
    out = kernels.convolve(kernels.packed(_depths(spark, d), "t", "v", "v"), _kernels(spark, d))
    return out.select("river_id", F.posexplode("v").alias("t", "v"))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('unit', 2, lateral=_UNIT)}", "net", "qlateral", "uh_inputs"))
def unit_route(spark, d):
    return _series(routing.route("unit", views.net(spark, d), _unit_lateral(spark, d), views.hours(spark, d), HOUR, 2))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('unit', 2, lateral=_UNIT)}", "net", "qlateral", "uh_inputs"))
def unit_route_levels(spark, d):
    return _series(routing.route("unit", views.net(spark, d), _unit_lateral(spark, d), views.hours(spark, d), HOUR, 2, strategy="levels", task_numbers=_few(spark, d, 2 * views.hours(spark, d))))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('unit', 2, lateral=_UNIT)}", "net", "qlateral", "uh_inputs"))
def unit_route_chunks(spark, d):
    return _series(routing.route("unit", views.net(spark, d), _unit_lateral(spark, d), views.hours(spark, d), HOUR, 2, strategy="chunks", chunk=48))


_GRID_VOLUME = f"SELECT river_id, t, v * 0.001 * a AS v FROM ({_DEPTH}) JOIN (SELECT river_id, sum(area_sqm) AS a FROM weights GROUP BY 1) USING (river_id)"


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid', lateral=_GRID_VOLUME, hours='(SELECT max(t) + 1 FROM gridcells)')}", "net", "grid", "weights"))
def rapid_route_volumes_from_grid(spark, d):
    grid = views.grid(spark, d)
    n = (grid.agg(F.max("t")).first()[0] or 0) + 1
    lateral = runoff.to_qlateral(grid, views.weights(spark, d), unit="mm", volumes=True)
    return _series(routing.route("rapid", views.net(spark, d), lateral, n, HOUR))


@query(sql(f"SELECT river_id, CAST(t // 6 AS INT) AS t, round(avg(q), 6) AS q FROM {_mean_sql('rapid')} GROUP BY 1, 2", "net", "qlateral"))
def discharge_resample_mean(spark, d):
    routed = routing.route("rapid", views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d), HOUR)
    return routing.mean_by(routing.long_series(routed), 6, "river_id").withColumn("q", r6("q", "q"))


@query(sql(f"SELECT river_id, round(full_, 6) AS q FROM {_solver_sql('rapid')} WHERE s = {H} - 1", "net", "qlateral"))
def channel_final_state(spark, d):
    routed = routing.route("rapid", views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d), HOUR)
    return routed.select("river_id", r6("state", "q"))


@query(sql(f"SELECT river_id, t, round(q, 6) AS q FROM {_mean_sql('rapid')}", "net", "qlateral"))
def sequential_state_carry(spark, d):
    """The series in two pieces, the second from the first one's state: as if it had been whole."""
    net, q, n = views.net(spark, d), views.qlateral(spark, d), views.hours(spark, d)
    routed = written(routing.route("rapid", net, q.where("t < 24"), 24, HOUR), "first-piece")
    rest = routing.route("rapid", net, q.where("t >= 24").withColumn("t", F.col("t") - 24), n - 24, HOUR, state=routed.select("river_id", F.col("state").alias("q")))
    return _series(routed).union(_series(rest).withColumn("t", F.col("t") + 24))


def _ensemble(spark, d):
    return routing.route("rapid", views.net(spark, d), views.lateral_arrays_members(spark, d), views.hours(spark, d), HOUR, member="member")


#: All members as one network: their rivers numbered on, member by member.
_ALL = _solver_sql("rapid", lateral="SELECT river_id, t, v FROM lateral_members", net="net_members")
_MEMBERS = f"(SELECT member, f.river_id - m * (SELECT count(*) FROM net) AS river_id, s, full_ FROM {_ALL} f JOIN members ON (f.river_id - 1) // (SELECT count(*) FROM net) = m)"


@query(sql(f"SELECT member, CAST(river_id AS BIGINT) AS river_id, CAST(s AS INT) AS t, round(greatest(full_, 0), 6) AS q FROM {_MEMBERS}", "net_members", "lateral_members"))
def ensemble_discharge(spark, d):
    return _series(_ensemble(spark, d), "member")


@query(sql(f"SELECT CAST(river_id AS BIGINT) AS river_id, round(avg(full_), 6) AS q FROM {_MEMBERS} WHERE s = {H} - 1 GROUP BY 1", "net_members", "lateral_members"))
def ensemble_mean_state(spark, d):
    return _ensemble(spark, d).groupBy("river_id").agg(r6(F.avg("state"), "q"))


@query(sql(f"SELECT CAST(river_id AS BIGINT) AS river_id, round(avg(greatest(full_, 0)), 6) AS q FROM {_MEMBERS} WHERE s = 24 GROUP BY 1", "net_members", "lateral_members"))
def lead_time_state(spark, d):
    """The members' mean a day ahead."""
    return _ensemble(spark, d).groupBy("river_id").agg(r6(F.avg(F.element_at("discharge", 25)), "q"))


@query(sql(f"SELECT river_id, TIMESTAMP '{START}' + to_hours(CAST(t AS BIGINT)) AS time, CAST(round(q, 4) AS DOUBLE) AS q FROM {_mean_sql('rapid')} WHERE river_id = {TARGET}", "net", "qlateral"))
def discharge_point_query(spark, d):
    """Only what lies upstream of the point is routed."""
    part, _ = network.subset(views.net(spark, d), TARGET)
    part = written(part, "upstream")
    lateral = views.qlateral(spark, d).join(part.select("river_id"), "river_id", "left_semi")
    routed = routing.route("rapid", part, lateral, views.hours(spark, d), HOUR).where(F.col("river_id") == TARGET)
    return io.with_dates(routing.long_series(routed), START, HOUR).select("river_id", "time", F.round("q", 4).alias("q"))


# --- skill ----------------------------------------------------------------------------------------------------------------------------------


def _metric(name: str, column: Callable[[Column, Column], Column], expression: str) -> None:
    def run(spark, d):
        return views.pairs(spark, d).groupBy("river_id").agg((F.round(column(F.col("obs"), F.col("sim")), 6) + 0.0).alias(name))

    ENTRIES[name] = (run, sql(f"SELECT river_id, round({expression}, 6) + 0.0 AS {name} FROM pairs GROUP BY 1", "pairs"))


_SAFE = "nullif(stddev_pop(obs), 0)"
_R = "covar_pop(obs, sim) / nullif(stddev_pop(obs) * stddev_pop(sim), 0)"
_metric("me", metrics.me, "avg(obs - sim)")
_metric("mae", metrics.mae, "avg(abs(obs - sim))")
_metric("mse", metrics.mse, "avg((obs - sim) * (obs - sim))")
_metric("pearson_r", metrics.pearson_r, f"coalesce({_R}, 'nan'::DOUBLE)")
_metric(
    "kge2012",
    metrics.kge2012,
    f"""coalesce(1 - sqrt(pow({_R} - 1, 2) + pow(avg(sim) / nullif(avg(obs), 0) - 1, 2)
    + pow((avg(sim) / nullif(stddev_pop(sim), 0)) / nullif(avg(obs) / {_SAFE}, 0) - 1, 2)), 'nan'::DOUBLE)""",
)


def _filled() -> dict[str, tuple[Query, str]]:
    """All entries, those of the catalogue of files with them."""
    importlib.import_module("thalweg.plans.file_catalog")
    return ENTRIES


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _filled().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _filled().items()}
