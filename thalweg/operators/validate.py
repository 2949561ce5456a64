"""Checks of inputs: each gives rows (rule, river_id) of what violates it; none means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators import network
from thalweg.operators.weights import WEIGHT_COLUMNS


def _rows(df: DataFrame, rule: str, where: Column | str | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df.select(F.lit(rule).alias("rule"), F.col("river_id").cast("long").alias("river_id"))


def _columns(df: DataFrame, need: set[str], what: str) -> None:
    if missing := need - set(df.columns):
        raise ValueError(f"{what} lacks the columns {sorted(missing)}")


def _integer(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    types = dict(df.dtypes)
    if bad := [n for n in names if types[n] not in ("tinyint", "smallint", "int", "bigint")]:
        raise ValueError(f"{what}: {bad} must be integers")


def params(net: DataFrame) -> DataFrame:
    """Of routing parameters, in topological order by `position` where there is one."""
    _columns(net, {"river_id", "downstream_river_id", "k", "x"}, "the parameter table")
    _integer(net, ("river_id", "downstream_river_id"), "the parameter table")
    found = [
        _rows(net, "null id", "river_id IS NULL"),
        _rows(net, "null downstream id", "downstream_river_id IS NULL"),
        _rows(network.duplicate_ids(net), "repeated id"),
        _rows(net, "downstream id below -1", "downstream_river_id < -1"),
        _rows(network.unknown_downstream(net), "unknown downstream id"),
        _rows(net, "k not positive", "k IS NULL OR isnan(k) OR k <= 0"),
        _rows(net, "x outside 0 to 0.5", "x IS NULL OR isnan(x) OR x < 0 OR x > 0.5"),
    ]
    if "position" in net.columns:
        found.append(_rows(network.order_violations(net), "not before its downstream river"))
    return reduce(DataFrame.unionByName, found)


def weights(table: DataFrame, net: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Of grid weights, against the network."""
    _columns(table, set(WEIGHT_COLUMNS), "the weight table")
    _integer(table, ("river_id", "x_index", "y_index"), "the weight table")
    others = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in WEIGHT_COLUMNS[1:]])
    sums = table.groupBy("river_id").agg(F.sum("proportion").alias("p"))
    found = [
        _rows(table, "null id", "river_id IS NULL"),
        _rows(table.join(net.select("river_id"), "river_id", "left_anti"), "river not in the network"),
        _rows(table, "null value", others),
        _rows(table, "area not positive", "area_sqm <= 0"),
        _rows(table, "proportion outside 0 to 1", "proportion <= 0 OR proportion > 1"),
        _rows(sums, "proportions do not sum to 1", F.abs(F.col("p") - 1) > tolerance),
    ]
    return reduce(DataFrame.unionByName, found)


def channel_state(state: DataFrame, net: DataFrame) -> DataFrame:
    """Of a channel state (river_id, q): one row a river, none null or negative."""
    _columns(state, {"river_id", "q"}, "the channel state")
    found = [
        _rows(state, "null state", "q IS NULL"),
        _rows(state, "negative state", "q < 0"),
        _rows(net.join(state.select("river_id"), "river_id", "left_anti"), "river without a state"),
        _rows(state.join(net.select("river_id"), "river_id", "left_anti"), "state of an unknown river"),
        _rows(network.duplicate_ids(state), "repeated id"),
    ]
    return reduce(DataFrame.unionByName, found)


def require(violations: DataFrame, what: str) -> None:
    """Stops with the first rules that are violated."""
    rules = violations.groupBy("rule").count().orderBy("rule").limit(20).collect()
    if rules:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']} ({r['count']})" for r in rules))
