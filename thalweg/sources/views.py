"""Hydrologic views derived from the driver's tables, as DataFrames and as DuckDB common table expressions with the same arithmetic.

Their values have no hydrologic meaning; they exercise the operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def hours(spark: SparkSession, sf_dir: str) -> int:
    """Hours from START up to the last event's: the length of every hourly series."""
    last = table(spark, sf_dir, "events", "ts").agg(F.max(F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{START}', ts)"))).first()[0]
    return max(0, (-1 if last is None else int(last)) + 1)


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of three watersheds: river r flows to r div 2; 1, 2 and 3 are outlets."""
    r = (F.col("s_suppkey") + 1).cast("long")
    return table(spark, sf_dir, "supplier", "s_suppkey").select(
        r.alias("river_id"),
        F.when(r < 4, F.lit(-1).cast("long")).otherwise(F.floor(r / 2)).alias("downstream_river_id"),
        (F.lit(3600.0) * (1 + r % 5)).alias("k"),
        ((r % 5).cast("double") / 10).alias("x"),
    )


def _hourly(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    n = net(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "value").join(F.broadcast(n))  # one row
    e = e.select("event_type", (F.col("user_id") % F.col("n") + 1).alias("river_id"), F.expr(f"cast(timestampdiff(HOUR, TIMESTAMP_NTZ'{START}', ts) AS INT)").alias("t"), "value")
    return e.where("t >= 0").groupBy("river_id", "t", *keys).agg(F.sum("value").alias("v"))


def _with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.expr(f"timestampadd(HOUR, t, TIMESTAMP_NTZ'{START}')"))


def lateral_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, v: an array by hour for each river, missing hours 0. Only hours with events are shuffled; whole series are made where their river is."""
    found = _hourly(spark, sf_dir).groupBy("river_id").agg(_pairs().alias("__pairs"))
    return net(spark, sf_dir).select("river_id").join(found, "river_id", "left").select("river_id", _dense("__pairs", hours(spark, sf_dir)).alias("v"))


def lateral_arrays_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lateral_arrays, for each event type as an ensemble member."""
    members = table(spark, sf_dir, "events", "event_type").distinct().select(F.col("event_type").alias("member"))
    found = _hourly(spark, sf_dir, "event_type").repartition("river_id").groupBy("river_id", "event_type").agg(_pairs().alias("pairs"))
    found = found.groupBy("river_id").agg(F.collect_list(F.struct("event_type", "pairs")).alias("__found"))  # at most a place a member
    rivers = net(spark, sf_dir).select("river_id").join(found, "river_id", "left").join(F.broadcast(members))  # five rows
    own = F.get(F.filter("__found", lambda x: x["event_type"] == F.col("member")), F.lit(0))["pairs"]
    return rivers.select("member", "river_id", own.alias("__pairs")).select("member", "river_id", _dense("__pairs", hours(spark, sf_dir)).alias("v"))


def _pairs() -> Column:
    return F.collect_list(F.struct("t", F.coalesce("v", F.lit(0.0)).alias("v")))


def _dense(pairs: str, n: int) -> Column:
    """An array of n numbers from pairs (t, v), 0 where there is none. Rows stay where they are, and as they are dealt."""

    @F.arrow_udf("array<double>")
    def dense(t: pa.Array, v: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(t)), t.value_lengths().fill_null(0).to_numpy())
        out = np.zeros(len(t) * n)
        out[rows * n + t.flatten().to_numpy()] = v.flatten().to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * n, pa.int32()), pa.array(out))

    return dense(F.col(f"{pairs}.t"), F.col(f"{pairs}.v"))


def by_hour(arrays: DataFrame) -> DataFrame:
    """A row for each number of arrays by hour: t, time, v."""
    return _with_time(arrays.select(*(c for c in arrays.columns if c != "v"), F.posexplode("v").alias("t", "v")))


def qlateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, t, time, v: an hourly series for each river, missing hours 0."""
    return by_hour(lateral_arrays(spark, sf_dir)).select("river_id", "t", "time", "v")


def qlateral_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As qlateral, for each event type as an ensemble member."""
    return by_hour(lateral_arrays_members(spark, sf_dir)).select("member", "river_id", "t", "time", "v")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, x_index, y_index, ro: a monthly runoff cube over 12 by 8 cells, dense."""
    cells = table(spark, sf_dir, "lineitem", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity").select(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("t"),
        (F.col("l_partkey") % 12).cast("int").alias("x_index"),
        (F.col("l_suppkey") % 8).cast("int").alias("y_index"),
        "l_quantity",
    )
    found = cells.groupBy("t", "x_index", "y_index").agg(F.sum("l_quantity").alias("ro"))
    last = cells.agg(F.max("t").alias("last"))
    dense = last.select(F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    dense = dense.withColumn("x_index", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("y_index", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return dense.join(found, ["t", "x_index", "y_index"], "left").withColumn("ro", F.coalesce("ro", F.lit(0.0)) / 1000)


def gappy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without every fifth month from the fourth on, and NaN in one cell every seventh month."""
    g = grid(spark, sf_dir).where("t % 5 <> 3")
    return g.withColumn("ro", F.when((F.col("t") % 7 == 2) & (F.col("x_index") == 3) & (F.col("y_index") == 1), F.lit(float("nan"))).otherwise(F.col("ro")))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, x_index, y_index, x, y, area_sqm, proportion: three cells for each river."""
    from thalweg.operators.weights import proportions

    r, j = F.col("river_id"), F.col("j")
    df = net(spark, sf_dir).select("river_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select(
        "river_id",
        ((r + j) % 12).cast("int").alias("x_index"),
        ((r + 2 * j) % 8).cast("int").alias("y_index"),
        (1e6 * (1 + (7 * r + 3 * j) % 5)).alias("area_sqm"),
    )
    df = df.withColumn("x", F.col("x_index") * 30.0).withColumn("y", F.col("y_index") * 15.0 - 60.0)
    return proportions(df)


def uh_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, tc, area: what kernels are built from."""
    area = weights(spark, sf_dir).groupBy("river_id").agg(F.sum("area_sqm").alias("area"))
    return net(spark, sf_dir).join(area, "river_id").select("river_id", (5 * F.col("k")).alias("tc"), "area")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, q: a channel state."""
    return net(spark, sf_dir).select("river_id", (10.0 + F.col("river_id") % 7).alias("q"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, obs, sim: a series against itself an hour late; river 1 observes a constant."""
    q = qlateral(spark, sf_dir)
    late = q.select("river_id", (F.col("t") + 1).alias("t"), F.col("v").alias("sim"))
    return q.join(late, ["river_id", "t"]).select("river_id", F.when(F.col("river_id") == 1, F.lit(1.0)).otherwise(F.col("v")).alias("obs"), "sim")


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, ds_river_id: the network without every tenth river."""
    return net(spark, sf_dir).where("river_id % 10 <> 0").select("river_id", F.col("downstream_river_id").alias("ds_river_id"))


def bad_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network in topological order with one violation each: a repeated id, an unknown downstream, k, x, and order."""
    r, extra = F.col("river_id"), net(spark, sf_dir).where("river_id = 7")
    n = net(spark, sf_dir).unionByName(extra)
    return n.select(
        F.when(r == 4, F.lit(100000).cast("long")).otherwise(-r).alias("position"),
        "river_id",
        F.when(r == 5, F.lit(999999).cast("long")).otherwise(F.col("downstream_river_id")).alias("downstream_river_id"),
        F.when(r == 6, F.lit(0.0)).otherwise(F.col("k")).alias("k"),
        F.when(r == 8, F.lit(0.9)).otherwise(F.col("x")).alias("x"),
    )


def axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(x_index, x) and (y_index, y) of a regular grid from 0 to 330 degrees east and 60 south to 60 north: a line for each residue of keys."""
    x = table(spark, sf_dir, "part", "p_partkey").select((F.col("p_partkey") % 12).cast("int").alias("x_index")).distinct()
    y = table(spark, sf_dir, "supplier", "s_suppkey").select((F.col("s_suppkey") % 9).cast("int").alias("y_index")).distinct()
    return x.withColumn("x", F.col("x_index") * 30.0), y.withColumn("y", F.col("y_index") * 15.0 - 60.0)


def wkb_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, geometry (WKB): for each nation an L of two rectangles, and a rectangle with a rectangular hole."""

    def rings(k: int) -> list[list[list[tuple[float, float]]]]:
        x, y = k * 9.0 - 120, k * 3.0 - 50
        box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
        bend = [(x, y), (x + 14, y), (x + 14, y + 4), (x + 6, y + 4), (x + 6, y + 10), (x, y + 10), (x, y)]
        return [[bend], [box(x + 20, y, x + 40, y + 12), box(x + 24, y + 3, x + 35, y + 9)]]

    def encoded(batches):
        for pdf in batches:
            yield pdf.assign(geometry=[geometry.multipolygon(rings(int(k) - 1)) for k in pdf["river_id"]])

    from thalweg.functions import geometry

    ids = table(spark, sf_dir, "nation", "n_nationkey").select((F.col("n_nationkey") + 1).cast("long").alias("river_id"))
    return ids.mapInPandas(encoded, "river_id long, geometry binary")


def slanted_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, rings: for each nation a right-angled triangle with a triangular hole."""
    k = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation", "n_nationkey").select((k + 1).cast("long").alias("river_id"), (k * 9.0 - 120).alias("x0"), (k * 3.0 - 50).alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    triangle = lambda a, b, w, h: F.array(corner(a, b), corner(a + w, b), corner(a, b + h), corner(a, b))
    return b.select("river_id", F.array(triangle(0, 0, 30, 14), triangle(3, 2, 9, 4)).alias("rings"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, ring: a rectangular catchment for each nation, as a closed ring of (x, y)."""
    k = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation", "n_nationkey").select((k + 1).cast("long").alias("river_id"), (k * 11.0 - 140).alias("x0"), (k * 4.0 - 50).alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return b.select("river_id", F.array(corner(0, 0), corner(20, 0), corner(20, 12), corner(0, 12), corner(0, 0)).alias("ring"))


#: The same views for DuckDB, in the order of their use of one another.
SQL = {
    "net": """SELECT CAST(s_suppkey + 1 AS BIGINT) AS river_id, CAST(CASE WHEN s_suppkey + 1 < 4 THEN -1 ELSE (s_suppkey + 1) // 2 END AS BIGINT) AS downstream_river_id,
        CAST(3600 * (1 + (s_suppkey + 1) % 5) AS DOUBLE) AS k, CAST((s_suppkey + 1) % 5 AS DOUBLE) / 10 AS x FROM supplier""",
    "hourly": f"""SELECT user_id % (SELECT count(*) FROM net) + 1 AS river_id, event_type, CAST(date_diff('hour', TIMESTAMP '{START}', ts) AS INT) AS t, value
        FROM events WHERE date_diff('hour', TIMESTAMP '{START}', ts) >= 0""",
    "horizon": f"SELECT max(date_diff('hour', TIMESTAMP '{START}', ts)) + 1 AS n FROM events",
    "qlateral": f"""SELECT n.river_id, CAST(h.t AS INT) AS t, TIMESTAMP '{START}' + to_hours(CAST(h.t AS BIGINT)) AS time, coalesce(e.v, 0.0::DOUBLE) AS v
        FROM net n CROSS JOIN range((SELECT n FROM horizon)) h(t) LEFT JOIN (SELECT river_id, t, sum(value) AS v FROM hourly GROUP BY 1, 2) e ON e.river_id = n.river_id AND e.t = h.t""",
    "qlateral_members": f"""SELECT m.member, n.river_id, CAST(h.t AS INT) AS t, TIMESTAMP '{START}' + to_hours(CAST(h.t AS BIGINT)) AS time, coalesce(e.v, 0.0::DOUBLE) AS v
        FROM net n CROSS JOIN range((SELECT n FROM horizon)) h(t) CROSS JOIN (SELECT DISTINCT event_type AS member FROM events) m
        LEFT JOIN (SELECT river_id, t, event_type AS member, sum(value) AS v FROM hourly GROUP BY 1, 2, 3) e ON e.river_id = n.river_id AND e.t = h.t AND e.member = m.member""",
    "members": "SELECT event_type AS member, row_number() OVER (ORDER BY event_type) - 1 AS m FROM (SELECT DISTINCT event_type FROM events)",
    "net_members": """SELECT CAST(river_id + m * (SELECT count(*) FROM net) AS BIGINT) AS river_id, CAST(CASE WHEN downstream_river_id < 0 THEN -1 ELSE downstream_river_id + m * (SELECT count(*) FROM net) END AS BIGINT) AS downstream_river_id, k, x
        FROM net CROSS JOIN members""",
    "lateral_members": "SELECT river_id + m * (SELECT count(*) FROM net) AS river_id, t, v FROM qlateral_members JOIN members USING (member)",
    "gridcells": """SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS t, CAST(l_partkey % 12 AS INT) AS x_index, CAST(l_suppkey % 8 AS INT) AS y_index, l_quantity FROM lineitem""",
    "grid": """SELECT CAST(a.t AS INT) AS t, CAST(b.x AS INT) AS x_index, CAST(c.y AS INT) AS y_index, coalesce(g.ro, 0.0::DOUBLE) / 1000 AS ro
        FROM range((SELECT max(t) + 1 FROM gridcells)) a(t) CROSS JOIN range(12) b(x) CROSS JOIN range(8) c(y)
        LEFT JOIN (SELECT t, x_index, y_index, sum(l_quantity) AS ro FROM gridcells GROUP BY 1, 2, 3) g ON g.t = a.t AND g.x_index = b.x AND g.y_index = c.y""",
    "gappy": "SELECT t, x_index, y_index, CASE WHEN t % 7 = 2 AND x_index = 3 AND y_index = 1 THEN 'nan'::DOUBLE ELSE ro END AS ro FROM grid WHERE t % 5 <> 3",
    "weights": """SELECT *, area_sqm / sum(area_sqm) OVER (PARTITION BY river_id) AS proportion FROM (
        SELECT river_id, CAST((river_id + j) % 12 AS INT) AS x_index, CAST((river_id + 2 * j) % 8 AS INT) AS y_index,
        CAST((river_id + j) % 12 AS DOUBLE) * 30 AS x, CAST((river_id + 2 * j) % 8 AS DOUBLE) * 15 - 60 AS y, CAST(1000000 * (1 + (7 * river_id + 3 * j) % 5) AS DOUBLE) AS area_sqm
        FROM net CROSS JOIN range(3) r(j))""",
    "uh_inputs": "SELECT river_id, 5 * k AS tc, area FROM net JOIN (SELECT river_id, sum(area_sqm) AS area FROM weights GROUP BY 1) USING (river_id)",
    "state": "SELECT river_id, CAST(10 + river_id % 7 AS DOUBLE) AS q FROM net",
    "pairs": "SELECT a.river_id, CASE WHEN a.river_id = 1 THEN 1.0::DOUBLE ELSE a.v END AS obs, b.v AS sim FROM qlateral a JOIN qlateral b ON a.river_id = b.river_id AND a.t = b.t + 1",
    "connectivity": "SELECT river_id, downstream_river_id AS ds_river_id FROM net WHERE river_id % 10 <> 0",
    "bad_net": """SELECT CAST(CASE WHEN river_id = 4 THEN 100000 ELSE -river_id END AS BIGINT) AS position, river_id, CAST(CASE WHEN river_id = 5 THEN 999999 ELSE downstream_river_id END AS BIGINT) AS downstream_river_id,
        CASE WHEN river_id = 6 THEN 0.0::DOUBLE ELSE k END AS k, CASE WHEN river_id = 8 THEN 0.9::DOUBLE ELSE x END AS x FROM (SELECT * FROM net UNION ALL SELECT * FROM net WHERE river_id = 7)""",
    "roots": """SELECT river_id, watershed_id, dist FROM (WITH RECURSIVE up(river_id, watershed_id, dist) AS (SELECT river_id, river_id, 0 FROM net WHERE downstream_river_id < 0
        UNION ALL SELECT n.river_id, u.watershed_id, u.dist + 1 FROM net n JOIN up u ON n.downstream_river_id = u.river_id) SELECT * FROM up)""",
}


def sql(body: str, *names: str) -> str:
    """`body` behind the named views and those that they use."""
    needs = {"hourly": ["net"], "qlateral": ["hourly", "horizon"], "qlateral_members": ["hourly", "horizon"], "members": [], "net_members": ["net", "members"], "lateral_members": ["net", "members", "qlateral_members"], "grid": ["gridcells"], "gappy": ["grid"], "weights": ["net"], "uh_inputs": ["weights"], "state": ["net"], "pairs": ["qlateral"], "connectivity": ["net"], "bad_net": ["net"], "roots": ["net"]}

    def closure(name: str) -> set[str]:
        return {name}.union(*(closure(n) for n in needs.get(name, ())))

    want = set().union(*(closure(n) for n in names))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text})" for n, text in SQL.items() if n in want) + ("\n" if body.lstrip().startswith(",") else "\n") + body
