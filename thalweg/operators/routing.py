"""Muskingum routing of flow through a forest of rivers.

A segment's series needs only those of its upstream segments, so a watershed is solved from its headwaters down, each segment over the whole
horizon: what it receives is summed, and its own flow is a first-order recurrence over substeps. In the terms used here a segment has

    x[s] = c1 * sum(now[s]) + c2 * sum(prev[s]) + c3 * x[s - 1] + lat[s]

where `now` and `prev` are what its upstream segments publish. For the channel and rapid kinds a segment publishes its flow and its flow a
substep earlier, and lat is nothing or (c1 + c2) / dt_runoff times its inflow volume. For the unit kind headwaters carry their convolved inflow
and publish it as both; the others publish x plus their own inflow, which is also their discharge. Emitted values are means over the
substeps of a step, not below 0; the state that is carried on is the last substep, as it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Literal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.functions.kernels import packed, packed_rows
from thalweg.operators.network import with_roots
from thalweg.session import spent, written

Kind = Literal["channel", "rapid", "unit"]
RESULT = "watershed_id long, river_id long, discharge array<double>, state double"


def coefficients(net: DataFrame, dt: float) -> DataFrame:
    """net with c1, c2, c3 (which sum to 1) and c4 = c1 + c2, for steps of dt seconds. k must be positive."""
    ratio, x = F.lit(float(dt)) / F.col("k"), F.col("x")
    below = ratio + 2 * (1 - x)
    out = net.withColumns({"c1": (ratio - 2 * x) / below, "c2": (ratio + 2 * x) / below, "c3": (2 * (1 - x) - ratio) / below})
    return out.withColumn("c4", F.col("c1") + F.col("c2"))


@dataclass(frozen=True)
class Steps:
    """Seconds: of routing, of lateral inflow, of output, and in all."""

    routing: int
    runoff: int
    discharge: int
    total: int

    def __post_init__(self):
        for big, small in (("total", "discharge"), ("discharge", "runoff"), ("runoff", "routing")):
            a, b = getattr(self, big), getattr(self, small)
            if b <= 0 or a < b:
                raise ValueError(f"dt_{big} must be at least dt_{small}, which must be positive")
            if a % b:
                raise ValueError(f"dt_{big} must be a multiple of dt_{small}")

    @property
    def substeps(self) -> int:
        return self.runoff // self.routing


def respond(kind: Kind, c: np.ndarray, now: np.ndarray, prev: np.ndarray, lateral: np.ndarray | None, q0: np.ndarray, substeps: int, dt_runoff: float, fed: np.ndarray, f0: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rivers of one level at once. c: (n, 3); now, prev: (n, S); lateral: (n, T); q0: x before the first substep, f0: what was published then.
    Gives discharge (n, T), state (n), and what is published."""
    n, s_count = now.shape
    spread = np.zeros((n, s_count)) if lateral is None else np.repeat(lateral, substeps, axis=1)
    source = spread * ((c[:, 0] + c[:, 1]) / dt_runoff)[:, None] if kind == "rapid" else np.zeros((n, s_count))
    forced = c[:, :1] * now + c[:, 1:2] * prev + source
    x, last = np.empty((n, s_count)), q0.copy()
    for s in range(s_count):
        last = forced[:, s] + c[:, 2] * last
        x[:, s] = last
    if kind == "unit":
        full = np.where(fed[:, None], x + spread, spread)
        before = np.where(fed[:, None], np.concatenate([f0[:, None], full[:, :-1]], axis=1), spread)
    else:
        full, before = x, np.concatenate([f0[:, None], x[:, :-1]], axis=1)
    mean = full.reshape(n, -1, substeps).mean(axis=2)
    # Headwaters of the unit kind pass their inflow on as it is; the rest is floored at 0, also where it is not a number.
    out = np.where(~fed[:, None], mean, np.where(mean > 0, mean, 0.0)) if kind == "unit" else np.where(mean > 0, mean, 0.0)
    return out, full[:, -1] if s_count else q0, full, before


def solve(kind: Kind, pdf: pd.DataFrame, substeps: int, dt_runoff: float, n_steps: int, inflow: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[pd.DataFrame, list[tuple]]:
    """A watershed or a piece of one: river_id, downstream_river_id, dist, fed, c1..c3, v (array or null), q0 -> river_id, discharge, state.

    f0, if there, is what rivers published before the first substep (else q0). inflow: what a river gets from other pieces, now and before. Also given: (river_id, downstream id, now, before) of rivers that flow to others.
    """
    pdf = pdf.sort_values(["dist", "river_id"], ascending=[False, True], ignore_index=True)
    place = {r: i for i, r in enumerate(pdf["river_id"])}
    flows_to = pdf["downstream_river_id"].to_numpy()
    down = np.array([place.get(d, -1) for d in flows_to])
    n, s_count = len(pdf), n_steps * substeps
    c, q0, dist = pdf[["c1", "c2", "c3"]].to_numpy(float), pdf["q0"].to_numpy(float), pdf["dist"].to_numpy()
    f0 = pdf["f0"].to_numpy(float) if "f0" in pdf else q0
    lateral = None if kind == "channel" else np.stack(pdf["v"].to_list()).astype(float)
    fed = pdf["fed"].to_numpy(bool)
    discharge, state, out = np.zeros((n, n_steps)), np.zeros(n), []
    # Only what is still to be received is held: the sums of a level leave once it is solved.
    now = {place[r]: x for r, (x, _) in (inflow or {}).items()}
    prev = {place[r]: x for r, (_, x) in (inflow or {}).items()}
    nothing = np.zeros(s_count)
    edges = np.flatnonzero(np.concatenate([[True], dist[1:] != dist[:-1], [True]]))
    for a, b in zip(edges, edges[1:], strict=False):
        rows = np.arange(a, b)
        got_now = np.stack([now.pop(i, nothing) for i in rows])
        got_prev = np.stack([prev.pop(i, nothing) for i in rows])
        discharge[a:b], state[a:b], full, before = respond(kind, c[a:b], got_now, got_prev, None if lateral is None else lateral[a:b], q0[a:b], substeps, dt_runoff, fed[a:b], f0[a:b])
        for i in rows:
            d = down[i]
            if d >= 0:
                now[d] = now[d] + full[i - a] if d in now else full[i - a]
                prev[d] = prev[d] + before[i - a] if d in prev else before[i - a]
            elif flows_to[i] >= 0:
                out.append((pdf["river_id"][i], flows_to[i], full[i - a], before[i - a]))
    return pd.DataFrame({"river_id": pdf["river_id"], "discharge": list(discharge), "state": state}), out


def _solved(kind: Kind, pdf: pd.DataFrame, substeps: int, dt_runoff: float, n_steps: int, inflow=None) -> tuple[pd.DataFrame, list[tuple]]:
    if kind != "channel" and any(len(v) != n_steps for v in pdf["v"]):
        raise ValueError(f"lateral inflow must have {n_steps} steps for every river")
    return solve(kind, pdf, substeps, dt_runoff, n_steps, inflow)


def with_fed(net: DataFrame) -> DataFrame:
    """net with fed: whether anything flows into a river."""
    fed = net.where("downstream_river_id >= 0").select(F.col("downstream_river_id").alias("__f")).distinct()
    return net.join(fed, F.col("river_id") == F.col("__f"), "left").withColumn("fed", F.col("__f").isNotNull()).drop("__f")


def with_states(net: DataFrame, state: DataFrame | None, dt_routing: float) -> DataFrame:
    """One row for each river: topology, coefficients, whether it is fed, and initial flow q0. A network that knows its roots, or what is fed, is not asked again."""
    base = net if "watershed_id" in net.columns else with_roots(net)
    base = coefficients(base if "fed" in net.columns else with_fed(base), dt_routing)
    if state is not None:
        base = base.join(state.select("river_id", "q"), "river_id", "left")
    return base.withColumn("q0", F.coalesce("q", F.lit(0.0)) if state is not None else F.lit(0.0))


def with_inflow(base: DataFrame, lateral: DataFrame | None, member: str | None = None) -> DataFrame:
    """base (a row a river) with the inflow array v, a row for each river and member.

    Joined by river_id; a river without a series, or a series without a river, stops the query. lateral: river_id, (member), and t, v or arrays v by step.
    """
    if lateral is None:
        return base.withColumn("v", F.lit(None).cast("array<double>"))
    arrays = packed_rows(lateral, *([member] if member else [])) if "t" in lateral.columns else lateral
    # A full outer join keeps what does not match, so that it can be told. Rivers are hashed, and series, which are long, pass by unsorted.
    joined = arrays.withColumnRenamed("river_id", "__r").join(base.hint("shuffle_hash"), F.col("river_id") == F.col("__r"), "full_outer")
    matched = F.when(F.col("river_id").isNull(), F.raise_error(F.lit("lateral inflow of a river that is not in the network"))).when(F.col("__r").isNull(), F.raise_error(F.lit("a river without lateral inflow"))).otherwise(F.col("river_id"))
    return joined.withColumn("river_id", matched.cast("long")).drop("__r")


def prepared(net: DataFrame, lateral: DataFrame | None, state: DataFrame | None, dt_routing: float, member: str | None = None) -> DataFrame:
    """One row for each river (and member): topology, coefficients, inflow array v and initial flow q0.

    A network that knows its roots (network.with_roots) is not searched for them again.
    """
    return with_inflow(with_states(net, state, dt_routing), lateral, member)


#: Columns of numbers that a routing task reads, besides those that name its rows.
OWN = ("river_id", "downstream_river_id", "dist", "fed", "c1", "c2", "c3", "q0")


def _series(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The arrays of an Arrow column, as views of its numbers."""
    out = []
    for part in column.chunks:
        numbers, at = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
        out += [numbers[i:j] if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), part.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return out


def _frame(table: pa.Table, *more: str) -> pd.DataFrame:
    return table.select([*OWN, *more]).to_pandas().assign(v=pd.Series(_series(table.column("v")), dtype=object))


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays as an Arrow column, their numbers copied at once."""
    sizes = np.array([0 if x is None else len(x) for x in arrays], np.int64)
    numbers = np.concatenate([np.zeros(0), *(x for x in arrays if x is not None)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(numbers), mask=pa.array([x is None for x in arrays], pa.bool_()))


def _solved_table(own: pd.DataFrame, out: pd.DataFrame) -> dict[str, pa.Array]:
    """Columns of RESULT. own, in order, is what out was solved from."""
    return {"watershed_id": pa.array(own["watershed_id"], pa.int64()), "river_id": pa.array(out["river_id"], pa.int64()), "discharge": _lists(out["discharge"].to_list()), "state": pa.array(out["state"], pa.float64())}


def route_grouped(kind: Kind, rows: DataFrame, substeps: int, dt_runoff: float, n_steps: int, member: str | None = None) -> DataFrame:
    """watershed_id, river_id, (member), discharge (array by step), state: a task for each watershed and member."""
    extra = [member] if member else []
    schema = RESULT + "".join(f", {m} string" for m in extra)

    def run(table: pa.Table) -> pa.Table:
        own = ordered(_frame(table, "watershed_id", *extra))
        out = _solved(kind, own, substeps, dt_runoff, n_steps)[0]
        return pa.table(_solved_table(own, out) | {m: pa.array(own[m], pa.string()) for m in extra})

    return rows.groupBy("watershed_id", *extra).applyInArrow(run, schema)


def cut_to_pieces(rows: DataFrame, most: int) -> DataFrame:
    """(river_id, piece, band): watersheds cut across at every `span` segments from the outlet, with the largest span, a power of 2, for which no piece
    has over `most` rivers (1 at last: a river is a piece). A piece is named by the river that it flows out of; it needs only those of the next band.

    Spans grow from 1: a piece of twice the span is one of the nearer half, or goes on from a piece of the farther half to that its outlet flows to.
    So each doubling takes one look at the pieces before it, and they are never searched for anew.
    """
    rivers = rows.select("river_id", "downstream_river_id", "dist").distinct()
    now, span = written(rivers.withColumn("piece", F.col("river_id")), "pieces"), 1
    depth = now.agg(F.max("dist")).first()[0] or 0
    while span <= depth:
        far = F.floor(F.col("dist") / span) % 2 == 1
        outlets = now.where(far & (F.col("river_id") == F.col("piece"))).select(F.col("piece").alias("__p"), F.col("downstream_river_id").alias("__d"))
        ahead = outlets.join(now.select(F.col("river_id").alias("__r"), F.col("piece").alias("__to")), F.col("__d") == F.col("__r")).select("__p", "__to")
        wider = now.join(ahead, F.col("piece") == F.col("__p"), "left").select("river_id", "downstream_river_id", "dist", F.coalesce("__to", "piece").alias("piece"))
        wider = written(wider, "pieces")
        if wider.groupBy("piece").count().agg(F.max("count")).first()[0] > most:
            spent(wider)
            break
        spent(now)
        now, span = wider, span * 2
    return now.select("river_id", "piece", F.floor(F.col("dist") / span).cast("int").alias("band"))


#: A task solves pieces of about so many times fewer rivers than it could: small ones together, and a large one alone or with a few.
SHARE = 8


def dealt(rivers: DataFrame, most: int) -> DataFrame:
    """(river_id, band, bin): pieces of at most `most` rivers, dealt by hash to bins of about most / SHARE rivers of one band, or of one piece."""
    cut = written(cut_to_pieces(rivers, most), "pieces-cut")
    bins = cut.groupBy(F.col("band").alias("__b")).agg(F.ceil(F.count(F.lit(1)) * SHARE / most).alias("bins"))
    return written(cut.join(F.broadcast(bins), F.col("band") == F.col("__b")).select("river_id", "band", F.pmod(F.xxhash64("piece"), "bins").alias("bin")), "pieces-dealt")  # a row a band


def route_pieces(kind: Kind, rows: DataFrame, substeps: int, dt_runoff: float, n_steps: int, member: str | None, named: DataFrame) -> DataFrame:
    """The same for watersheds too large for one task, given with band and bin and written by band: bins of pieces (named: river_id, band, bin) are solved
    band by band, from the headwaters down, each in a task; only the series of pieces' outlets go on to the next band. Bands are written to the shared
    folder."""
    extra = [member] if member else []
    given = ["now", "prev"]
    columns = ["bin", "watershed_id", *OWN, "v", *extra]
    series = {g: F.lit(None).cast("array<double>").alias(g) for g in given}
    schema = f"{RESULT}, downstream_river_id long, now array<double>, prev array<double>" + "".join(f", {m} string" for m in extra)
    target = named.select(F.col("river_id").alias("__r"), "bin", F.col("band").alias("__band"))

    def run(table: pa.Table) -> pa.Table:
        comes = table.filter(pc.is_valid(table.column("now")))
        inflow: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for river, now, prev in zip(comes.column("river_id").to_pylist(), *(_series(comes.column(g)) for g in given), strict=True):
            a, b = inflow.get(river, (0.0, 0.0))
            inflow[river] = (a + now, b + prev)
        own = ordered(_frame(table.filter(pc.is_null(table.column("now"))), "watershed_id", *extra))
        out, leaves = _solved(kind, own, substeps, dt_runoff, n_steps, inflow)
        leaves = {r: x for r, *x in leaves}
        to, now, prev = zip(*(leaves.get(r, (None, None, None)) for r in out["river_id"].tolist()), strict=True)
        found = _solved_table(own, out) | {"downstream_river_id": pa.array(to, pa.int64()), "now": _lists(now), "prev": _lists(prev)}
        return pa.table(found | {m: pa.array(own[m], pa.string()) for m in extra})

    last = named.agg(F.max("band")).first()[0]
    bands, above = [], None
    for band in range(last if last is not None else -1, -1, -1):
        here = rows.where(F.col("band") == band).select(*columns, *series.values())
        if above is not None:
            comes = above.where("downstream_river_id IS NOT NULL").join(target.where(F.col("__band") == band), F.col("downstream_river_id") == F.col("__r"))
            here = here.unionByName(comes.select("bin", F.col("__r").alias("river_id"), *given, *extra), allowMissingColumns=True)
        above = written(here.groupBy("bin", *extra).applyInArrow(run, schema), "pieces-band", *extra)
        bands.append(above.select("watershed_id", "river_id", "discharge", "state", *extra))
    return reduce(DataFrame.unionByName, bands) if bands else route_grouped(kind, rows, substeps, dt_runoff, n_steps, member)


# --- long horizons ---------------------------------------------------------------------------------------------------------------------------

#: Rivers of a watershed up to which the map over a chunk is held as a matrix.
MATRIX = 2000


def carried(kind: Kind, topology: pd.DataFrame, x: np.ndarray, substeps: int) -> np.ndarray:
    """Initial flows x (rivers in the order of `ordered`, any number of columns) after so many substeps without inflow."""
    place = {r: i for i, r in enumerate(topology["river_id"])}
    down = np.array([place.get(d, -1) for d in topology["downstream_river_id"]])
    c, dist = topology[["c1", "c2", "c3"]].to_numpy(float), topology["dist"].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], dist[1:] != dist[:-1], [True]]))
    # Headwaters of the unit kind carry their inflow on, and remember nothing.
    keeps = topology["fed"].to_numpy(bool)[:, None] if kind == "unit" else np.ones((len(topology), 1), bool)
    x = np.where(keeps, x, 0.0)
    for _ in range(substeps):
        now, new = np.zeros_like(x), np.zeros_like(x)
        prev = np.zeros_like(x)
        np.add.at(prev, down[down >= 0], x[down >= 0])
        for a, b in zip(edges, edges[1:], strict=False):
            new[a:b] = np.where(keeps[a:b], c[a:b, :1] * now[a:b] + c[a:b, 1:2] * prev[a:b] + c[a:b, 2:] * x[a:b], 0.0)
            flows = np.flatnonzero(down[a:b] >= 0) + a
            np.add.at(now, down[flows], new[flows])
        x = new
    return x


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["dist", "river_id"], ascending=[False, True], ignore_index=True)


def route_chunks(kind: Kind, net: DataFrame, lateral: DataFrame, substeps: int, dt_runoff: float, n_steps: int, chunk: int, state: DataFrame | None = None, member: str | None = None) -> DataFrame:
    """watershed_id, river_id, (member), first (step of the chunk), discharge (array), state (null but in the last chunk): parallel in time as well.

    Routing over a chunk of steps is an affine map of the flows before it, x -> M x + b; M is the same for all chunks. So b comes from routing each chunk
    from nothing, a task for each watershed and chunk; the maps are composed from chunk to chunk, a vector of flows for each; and each chunk is routed
    again from the flows before it. A task holds a chunk of a watershed's series, whatever the horizon, and between these a number a river and chunk.
    Watersheds of over MATRIX rivers apply M by routing the flows without inflow.
    """
    extra = [member] if member else []
    base = written(with_states(net, state, dt_runoff / substeps), "chunks-rivers")
    n_chunks = -(-n_steps // chunk)
    cut = lateral.withColumn("chunk", F.floor(F.col("t") / chunk).cast("int"))
    arrays = packed(cut, "t", "v", "v", "river_id", "chunk", *extra)
    members = [lateral.select(member).distinct()] if member else []
    due = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), members, base)  # members, few
    due = due.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))) if n_chunks else F.explode(F.array().cast("array<int>")))
    keys = ["river_id", "chunk", *extra]
    joined = due.join(arrays.select(*(F.col(c).alias(f"__{c}") for c in keys), "v"), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in keys]), "full_outer")
    size = F.least(F.lit(chunk), F.lit(n_steps) - F.col("chunk") * chunk)
    stop = lambda what: F.raise_error(F.lit(what))
    fits = F.when(F.col("river_id").isNull(), stop("lateral inflow of a river that is not in the network, or beyond the last step")).when(F.col("__river_id").isNull() | (F.size("v") != size), stop(f"lateral inflow must have {n_steps} steps for every river"))
    joined = joined.withColumn("river_id", fits.otherwise(F.col("river_id")).cast("long")).drop(*(f"__{c}" for c in keys))
    # What a river published before a chunk holds the inflow of the step before it (unit kind).
    last = F.element_at("v", -1)
    before = F.lag(last).over(W.partitionBy("river_id", *extra).orderBy("chunk")) if kind == "unit" else F.lit(0.0)
    columns = ["watershed_id", "river_id", "downstream_river_id", "dist", "fed", "c1", "c2", "c3", "q0", "chunk", "v", *extra]
    rows = written(joined.withColumn("before", F.coalesce(before, F.lit(0.0))).select(*columns, "before"), "chunks-input")
    where = ["watershed_id", "chunk", *extra]
    known = "".join(f", {m} string" for m in extra)

    def from_nothing(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ordered(pdf).assign(q0=0.0)
        own["f0"] = np.where(own["fed"], own["before"], 0.0) if kind == "unit" else 0.0
        out = solve(kind, own, substeps, dt_runoff, len(own["v"].iloc[0]))[0]
        end = np.where(own["fed"], out["state"] - own["v"].str[-1], 0.0) if kind == "unit" else out["state"]
        return own[where].assign(river_id=out["river_id"], b=end)

    ends = written(rows.groupBy(*where).applyInPandas(from_nothing, f"watershed_id long, chunk int{known}, river_id long, b double"), "chunks-ends")
    listed = ends.groupBy("river_id", *extra).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "b"))), lambda x: x["b"]).alias("b"))
    listed = listed.join(base, "river_id").select("watershed_id", "river_id", "downstream_river_id", "dist", "fed", "c1", "c2", "c3", "q0", "b", *extra)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ordered(pdf)
        b = np.stack(own["b"].to_list())
        starts, s = np.empty_like(b), chunk * substeps
        x = own["q0"].to_numpy(float)
        if kind == "unit":
            x = np.where(own["fed"], x, 0.0)
        m = carried(kind, own, np.eye(len(own)), s) if len(own) <= MATRIX else None
        for k in range(b.shape[1]):
            starts[:, k] = x
            if k + 1 < b.shape[1]:
                x = (m @ x if m is not None else carried(kind, own, x[:, None], s)[:, 0]) + b[:, k]
        return own[["river_id", *extra]].assign(starts=list(starts))

    starts = listed.groupBy("watershed_id", *extra).applyInPandas(composed, f"river_id long{known}, starts array<double>")
    starts = written(starts.select(F.col("river_id").alias("__r"), *(F.col(m).alias(f"__{m}") for m in extra), F.posexplode("starts").alias("__k", "start")), "chunks-starts")
    same = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"__{m}") for m in extra], (F.col("river_id") == F.col("__r")) & (F.col("chunk") == F.col("__k")))
    begun = rows.join(starts, same).select(*columns, "before", "start")

    def from_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ordered(pdf)
        own["f0"] = own["q0"] if own["chunk"].iloc[0] == 0 else own["start"] + own["before"]
        own["q0"] = own["start"]
        out = solve(kind, own, substeps, dt_runoff, len(own["v"].iloc[0]))[0]
        final = own["chunk"].iloc[0] == n_chunks - 1
        return out.assign(watershed_id=own["watershed_id"], first=own["chunk"] * chunk, state=out["state"] if final else None, **{m: own[m] for m in extra})

    return begun.groupBy(*where).applyInPandas(from_starts, f"watershed_id long, river_id long, first int, discharge array<double>, state double{known}")


def joined_up(chunks: DataFrame, *extra: str) -> DataFrame:
    """route_chunks() with one row a river."""
    each = F.array_sort(F.collect_list(F.struct("first", "discharge")))
    return chunks.groupBy("watershed_id", "river_id", *extra).agg(F.flatten(F.transform(each, lambda x: x["discharge"])).alias("discharge"), F.max("state").alias("state"))


#: Bytes that a routing task may take, and that it takes for each number of a series: as a column and stacked, in Arrow on the way in and out, as
#: discharge and its list, and for half of the rivers, on the widest level, eight times while that level is solved.
TASK_BYTES, NUMBER_BYTES = 512_000_000, 80
#: Numbers of a series that one task may hold for all its rivers: larger watersheds are cut to pieces.
TASK_NUMBERS = TASK_BYTES // NUMBER_BYTES


def route(
    kind: Kind,
    net: DataFrame,
    lateral: DataFrame | None,
    n_steps: int,
    dt_runoff: float,
    substeps: int = 1,
    state: DataFrame | None = None,
    member: str | None = None,
    strategy: Literal["auto", "grouped", "levels", "chunks"] = "auto",
    task_numbers: int = TASK_NUMBERS,
    chunk: int = 24,
    kept: bool = False,
) -> DataFrame:
    """Discharge arrays and states of all rivers. lateral: river_id, (member), and t, v or, but for chunks, arrays v by step. kept: as written tables,
    by member, to be read more than once.

    auto: watersheds whose series fit a task are solved whole, the others in pieces that fit. grouped: all whole; levels: all in pieces; chunks: all at
    once in chunks of time.
    """
    if strategy == "chunks" and lateral is not None:
        extra = [member] if member else []
        found = joined_up(route_chunks(kind, net, lateral, substeps, dt_runoff, n_steps, chunk, state, member), *extra)
        return written(found, "routed", *extra) if kept else found
    base = written(with_states(net, state, dt_runoff / substeps), "routing-rivers")
    most = max(1, task_numbers // max(1, n_steps * substeps))
    extra = [member] if member else []
    whole = lambda rows: route_grouped(kind, rows, substeps, dt_runoff, n_steps, member)
    keep = lambda routed: written(routed, "routed", *extra) if kept else routed
    if strategy == "grouped":
        return keep(whole(with_inflow(base, lateral, member)))
    sizes = base.groupBy(F.col("watershed_id").alias("__w")).agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > (0 if strategy == "levels" else most)).select("__w"), "routing-large")
    if large.isEmpty():
        return keep(whole(with_inflow(base, lateral, member)))
    named = dealt(base.join(large, F.col("watershed_id") == F.col("__w"), "left_semi"), most)
    places = named.select(F.col("river_id").alias("__p"), "band", "bin")
    placed = base.join(places, F.col("river_id") == F.col("__p"), "left").drop("__p").withColumn("band", F.coalesce("band", F.lit(-1)))
    rows = written(with_inflow(placed, lateral, member), "routing", "band")
    pieces = route_pieces(kind, rows, substeps, dt_runoff, n_steps, member, named)
    if strategy == "levels":
        return pieces
    return keep(whole(rows.where("band = -1"))).unionByName(pieces)


def long_series(routed: DataFrame, *keys: str) -> DataFrame:
    """keys, river_id, t, q."""
    return routed.select(*keys, "river_id", F.posexplode("discharge").alias("t", "q"))


def mean_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Series averaged over blocks of n steps, labelled by the first: keys, t (of blocks), q."""
    return df.groupBy(*keys, F.floor(F.col("t") / n).cast("int").alias("t")).agg(F.avg("q").alias("q"))
