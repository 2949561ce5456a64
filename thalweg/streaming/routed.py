"""Routing over a stream: a watershed's flows are its state, and each batch of steps is routed on from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thalweg.functions.kernels import runs
from thalweg.operators import routing
from thalweg.session import written

#: The last step that was routed, and by river, in the order of `routing.ordered`: x after it and what was published with it.
STATE = "done int, rivers array<bigint>, x array<double>, published array<double>"
#: Numbers of a watershed's that are solved and passed on at once.
BLOCK = 1 << 20


def matrix(key: int, rivers: np.ndarray, river: np.ndarray, t: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a batch, and the numbers of its n rivers (given in order) by step: whole steps, or the query stops."""
    steps = np.unique(t)
    whole = len(rivers) == n and len(t) == len(steps) * n and (np.diff(steps) == 1).all()
    if whole:
        place = np.searchsorted(rivers, river) * len(steps) + (t - steps[0])
        out, seen = np.empty(n * len(steps)), np.zeros(n * len(steps), bool)
        out[place], seen[place] = v, True
        whole = seen.all()  # as many as there are places: none is repeated
    if not whole:
        raise ValueError(f"watershed {key}: steps {steps[0]} to {steps[-1]} are not complete")
    return steps, out.reshape(n, len(steps))


def routed(stream: DataFrame, net: DataFrame, kind: routing.Kind, dt_runoff: int, substeps: int = 1, state: DataFrame | None = None) -> DataFrame:
    """river_id, t, q from a stream of lateral inflow (river_id, t, v) over a static network, started from `state` (river_id, q) or nothing.

    A batch holds whole steps: each river of a watershed once a step, from the one after the last on. Late, repeated, missing or incomplete steps stop
    the query, since the flows that they need are gone or not there yet; a restart goes on from the checkpoint. The first step may be any.

    A task holds a batch of a watershed's series once, as packed numbers; it solves them and passes them on in blocks of steps.
    """
    base = routing.with_states(net, state, dt_runoff / substeps).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("watershed_id")))
    base = written(base.select("watershed_id", "river_id", "downstream_river_id", "dist", "fed", "c1", "c2", "c3", "q0", "n"), "stream-rivers")

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        about, river, t, v = [], [], [], []
        for pdf in batches:
            sizes = pdf["t"].map(len).to_numpy()
            river.append(np.repeat(pdf["river_id"].to_numpy(), sizes))
            t.append(np.concatenate(pdf["t"].to_list()))
            v.append(np.concatenate(pdf["v"].to_list()).astype(float))
            about.append(pdf.drop(columns=["t", "v"]))
        own = routing.ordered(pd.concat(about).drop_duplicates("river_id"))
        rivers = own["river_id"].to_numpy()
        by_id = np.argsort(rivers)
        steps, series = matrix(key[0], rivers[by_id], *map(np.concatenate, (river, t, v)), int(own["n"].iloc[0]))
        del river, t, v, about
        done, ids, x, published = held.get if held.exists else (None, None, None, None)
        if done is not None and steps[0] != done + 1:
            raise ValueError(f"watershed {key[0]}: step {steps[0]} came after {done}")
        if ids is not None:
            if list(ids) != rivers.tolist():
                raise ValueError(f"watershed {key[0]}: its rivers are not those of its state")
            own["q0"], own["f0"] = np.array(x), np.array(published)
        place = np.argsort(by_id)  # of each river in the series
        length = max(1, BLOCK // (len(own) * substeps))
        for at in range(0, len(steps), length):
            own["v"] = list(series[place, at : at + length])
            out = routing.solve(kind, own, substeps, dt_runoff, len(own["v"].iloc[0]))[0]
            last = out["state"].to_numpy(float)
            ends = np.where(own["fed"], last - own["v"].str[-1].to_numpy(float), 0.0) if kind == "unit" else last
            own["q0"], own["f0"] = ends, last
            yield pd.DataFrame({"river_id": out["river_id"], "first": np.int32(steps[at]), "q": out["discharge"]})
        held.update((int(steps[-1]), rivers.tolist(), ends.tolist(), last.tolist()))

    rows = stream.select("river_id", "t", "v").mapInArrow(lambda batches: runs(batches, "river_id"), "river_id long, t array<int>, v array<double>").join(base, "river_id")
    found = rows.groupBy("watershed_id").applyInPandasWithState(run, "river_id long, first int, q array<double>", STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("river_id", F.posexplode("q").alias("p", "q"), "first").select("river_id", (F.col("first") + F.col("p")).alias("t"), "q")
