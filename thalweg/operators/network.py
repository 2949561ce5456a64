"""The river network: a forest in which each segment flows to at most one other. A negative downstream id marks an outlet."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.session import spent, written


def outlets(net: DataFrame) -> DataFrame:
    return net.where("downstream_river_id < 0")


def headwaters(net: DataFrame) -> DataFrame:
    """Segments that nothing flows into."""
    fed = net.select(F.col("downstream_river_id").alias("river_id")).distinct()
    return net.join(fed, "river_id", "left_anti")


def in_degree(net: DataFrame) -> DataFrame:
    """river_id, n_upstream of every segment."""
    n = net.where("downstream_river_id >= 0").groupBy(F.col("downstream_river_id").alias("river_id")).agg(F.count(F.lit(1)).alias("n"))
    return net.select("river_id").join(n, "river_id", "left").select("river_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_upstream"))


def duplicate_ids(net: DataFrame) -> DataFrame:
    return net.groupBy("river_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_downstream(net: DataFrame) -> DataFrame:
    """Segments whose downstream id is no river."""
    flows = net.where("downstream_river_id >= 0").select("river_id", "downstream_river_id")
    return flows.join(net.select(F.col("river_id").alias("downstream_river_id")).distinct(), "downstream_river_id", "left_anti").select("river_id", "downstream_river_id")


def order_violations(net: DataFrame) -> DataFrame:
    """Segments that do not come before their downstream one by `position`."""
    down = net.select(F.col("river_id").alias("__r"), F.col("position").alias("__p"))
    return net.join(down, F.col("downstream_river_id") == F.col("__r")).where("__p <= position").select("river_id", "downstream_river_id").distinct()


def adjacency(net: DataFrame) -> DataFrame:
    """downstream, upstream: an edge for each segment that is no outlet. Stops on unknown downstream ids, and on wrong order where there is a position."""
    if not unknown_downstream(net).isEmpty():
        raise ValueError("downstream ids that are no river")
    if "position" in net.columns and not order_violations(net).isEmpty():
        raise ValueError("the network is not sorted from upstream to downstream")
    return net.where("downstream_river_id >= 0").select(F.col("downstream_river_id").alias("downstream"), F.col("river_id").alias("upstream"))


def digraph(net: DataFrame) -> DataFrame:
    """src, dst of every segment, outlets flowing to the node -1."""
    return net.select(F.col("river_id").alias("src"), F.col("downstream_river_id").alias("dst"))


def rooted(net: DataFrame) -> DataFrame:
    """river_id, watershed_id (the outlet that it reaches), dist (segments to it), by pointer doubling: as many joins as the logarithm of the depth.

    Each round is written to the shared folder. A cycle would never end; more rounds than the network can be deep stop with an error.
    """
    down = F.col("downstream_river_id")
    now = written(net.select("river_id", F.when(down >= 0, down).alias("jump"), (down >= 0).cast("int").alias("dist"), F.col("river_id").alias("root")), "rooted")
    for _ in range(math.ceil(math.log2(max(2, now.count()))) + 2):
        if now.where("jump IS NOT NULL").isEmpty():
            return now.select("river_id", F.col("root").alias("watershed_id"), "dist")
        ahead = now.select(F.col("river_id").alias("__r"), F.col("jump").alias("__jump"), F.col("dist").alias("__dist"), F.col("root").alias("__root"))
        step = now.join(ahead, F.col("jump") == F.col("__r"), "left")
        now = written(step.select("river_id", F.col("__jump").alias("jump"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"), F.coalesce("__root", "root").alias("root")), "rooted")
    raise ValueError("the network has a cycle")


def with_roots(net: DataFrame) -> DataFrame:
    """net with watershed_id and dist."""
    found = rooted(net).withColumnRenamed("river_id", "__r")
    return net.join(found, F.col("river_id") == F.col("__r")).drop("__r")


def levels(net: DataFrame) -> DataFrame:
    """river_id, level: an order in which every segment comes after what flows into it (greatest distance to the outlet first)."""
    r = rooted(net)
    depth = r.agg(F.max("dist")).first()[0] or 0
    return r.select("river_id", (F.lit(depth) - F.col("dist")).alias("level"))


def watersheds(net: DataFrame) -> DataFrame:
    """watershed_id, n_rivers, depth."""
    return rooted(net).groupBy("watershed_id").agg(F.count(F.lit(1)).alias("n_rivers"), F.max("dist").alias("depth"))


def upstream(net: DataFrame, target: int) -> DataFrame:
    """The segments that reach the target, and itself: the network is cut below it and rooted."""
    cut = net.withColumn("downstream_river_id", F.when(F.col("river_id") == target, F.lit(-1).cast("long")).otherwise(F.col("downstream_river_id")))
    return rooted(cut).where(F.col("watershed_id") == target).select("river_id")


def subset(net: DataFrame, target: int, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The network above a river, which becomes its outlet, and its weights."""
    if net.where(F.col("river_id") == target).isEmpty():
        raise ValueError(f"river {target} is not in the network")
    keep = written(upstream(net, target), "subset")
    part = net.join(keep, "river_id", "left_semi").withColumn("downstream_river_id", F.when(F.col("river_id") == target, F.lit(-1).cast("long")).otherwise(F.col("downstream_river_id")))
    return part, weights.join(keep, "river_id", "left_semi") if weights is not None else None


# --- stream orders by tree contraction --------------------------------------------------------------------------------------------------------
#
# What a river's order is, as a function of one upstream order x that is not known yet, always has the form (a, p): a for x below p, a + 1 from p up to
# a + 1, and x beyond. Others upstream with a greatest order m make it (m + 1, m + 2) if two have it and (m, m) if one does; functions of this form
# one after another are of this form again.


def order_from(f: Column, x: Column) -> Column:
    return F.when(x < f["p"], f["a"]).when(x <= f["a"] + 1, f["a"] + 1).otherwise(x)


def order_after(outer: Column, inner: Column) -> Column:
    """The function of what lies upstream of the inner one."""
    pair = lambda a, p: F.struct(a.alias("a"), p.alias("p"))
    a, c, r = inner["a"], outer["a"], outer["p"]
    return F.when((a > c + 1) | ((a >= r) & (a == c + 1)), inner).when(a >= r, pair(c + 1, c + 2)).when(a + 1 == r, pair(c, inner["p"])).otherwise(pair(c, r))


def strahler(net: DataFrame) -> DataFrame:
    """river_id, strahler: 1 for headwaters; else the greatest upstream order, plus 1 if two have it.

    By tree contraction, in rounds that grow with the logarithm of the number of rivers, whatever the depth. Rake: rivers whose upstream orders are all
    known get theirs; those that wait for one only become links. Compress: a link whose river above is a link too takes that one's place, so
    that chains halve. Each round is written; a cycle is never contracted and stops with an error.
    """
    kind = "struct<a:int,p:int>"
    rivers = net.select("river_id", "downstream_river_id")
    fed = rivers.where("downstream_river_id >= 0").select(F.col("downstream_river_id").alias("__f")).distinct()
    now = rivers.join(fed, F.col("river_id") == F.col("__f"), "left").select(*rivers.columns, F.when(F.col("__f").isNull(), F.lit(1)).alias("strahler"), F.lit(None).cast("long").alias("above"), F.lit(None).cast(kind).alias("f"))
    now = written(now, "strahler")
    most = 4 * math.ceil(math.log2(max(2, now.count()))) + 8
    for _ in range(most):
        open_, forks = now.agg(F.count_if(F.col("strahler").isNull()), F.count_if(F.col("strahler").isNull() & F.col("above").isNull())).first()
        if not open_:
            return now.select("river_id", "strahler")
        parts = [now.where("strahler IS NOT NULL"), _compressed(now)]
        if forks:
            parts.append(_raked(now, kind))
        before, now = now, written(reduce(DataFrame.unionByName, parts), "strahler")
        spent(before)
    raise ValueError("the network has a cycle")


def _raked(now: DataFrame, kind: str) -> DataFrame:
    """Rivers that wait for several others, after a look at which of these are known. Counted by order first: however many flow into one river."""
    each = now.where("downstream_river_id >= 0").groupBy(F.col("downstream_river_id").alias("__d"), F.col("strahler").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.max("river_id").alias("one"))
    known = F.col("o").isNotNull()
    each = each.groupBy("__d").agg(F.max(F.when(known, F.struct("o", "n"))).alias("m"), F.max(F.when(~known, F.struct("n", "one"))).alias("u"))
    m, two = F.coalesce(F.col("m.o"), F.lit(0)), F.coalesce(F.col("m.n") > 1, F.lit(False))
    # With nothing known upstream the function is (0, 1): it gives x itself.
    f = F.when(F.col("m").isNull(), F.struct(F.lit(0).alias("a"), F.lit(1).alias("p"))).when(two, F.struct((m + 1).alias("a"), (m + 2).alias("p"))).otherwise(F.struct(m.alias("a"), m.alias("p")))
    joined = now.where("strahler IS NULL AND above IS NULL").join(each, F.col("river_id") == F.col("__d"))
    link = F.col("u.n") == 1
    return joined.select("river_id", "downstream_river_id", F.when(F.col("u").isNull(), m + two.cast("int")).alias("strahler"), F.when(link, F.col("u.one")).alias("above"), F.when(link, f).cast(kind).alias("f"))


def _compressed(now: DataFrame) -> DataFrame:
    """Links after one step: resolved where the river above is known, else over that river where it is a link itself."""
    ahead = now.select(F.col("river_id").alias("__r"), F.col("strahler").alias("__o"), F.col("above").alias("__above"), F.col("f").alias("__f"))
    joined = now.where("strahler IS NULL AND above IS NOT NULL").join(ahead, F.col("above") == F.col("__r"))
    over = F.col("__above").isNotNull()
    return joined.select(
        "river_id", "downstream_river_id", order_from(F.col("f"), F.col("__o")).alias("strahler"), F.when(over, F.col("__above")).otherwise(F.col("above")).alias("above"),
        F.when(over, order_after(F.col("f"), F.col("__f"))).otherwise(F.col("f")).alias("f"),
    )


def with_connectivity(params: DataFrame, connectivity: DataFrame, how: str = "inner") -> DataFrame:
    """Parameters (river_id, k, x) joined with a separate table of downstream ids (river_id, ds_river_id)."""
    for need, df in (({"river_id", "k", "x"}, params), ({"river_id", "ds_river_id"}, connectivity)):
        if missing := need - set(df.columns):
            raise KeyError(f"missing columns: {sorted(missing)}")
    return params.select("river_id", "k", "x").join(connectivity.select("river_id", F.col("ds_river_id").alias("downstream_river_id")), "river_id", how)


def inflow(net: DataFrame, flow: DataFrame) -> DataFrame:
    """river_id, t, inflow: what comes from upstream. flow: river_id, t, q."""
    from_above = net.where("downstream_river_id >= 0").select("river_id", "downstream_river_id").join(flow, "river_id")
    found = from_above.groupBy(F.col("downstream_river_id").alias("river_id"), "t").agg(F.sum("q").alias("inflow"))
    return flow.select("river_id", "t").join(found, ["river_id", "t"], "left").withColumn("inflow", F.coalesce("inflow", F.lit(0.0)))
