"""Unit hydrographs over a stream: one step of runoff at a time, with the carry-over as state by river."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thalweg.functions.kernels import Incremental


def convolved(stream: DataFrame, kernels: DataFrame) -> DataFrame:
    """river_id, t, q from a stream (river_id, t, v) and a static table (river_id, kernel). Steps of a river come in order across batches;
    a step that is not the next one stops the query, since its carry-over is gone."""
    rows = stream.join(kernels, "river_id")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("t")
        done, carry = state.get if state.exists else (None, None)
        one = Incremental(np.asarray(pdf["kernel"].iloc[0]), None if carry is None else np.array(json.loads(carry)))
        out = []
        for t, v in zip(pdf["t"], pdf["v"], strict=True):
            if done is not None and t != done + 1:
                raise ValueError(f"river {key[0]}: step {t} came after {done}")
            out.append(one.step(v))
            done = int(t)
        state.update((done, json.dumps(one.state.tolist())))
        yield pd.DataFrame({"river_id": key[0], "t": pdf["t"].to_numpy(), "q": out})

    return rows.groupBy("river_id").applyInPandasWithState(run, "river_id long, t int, q double", "done int, carry string", "append", GroupStateTimeout.NoTimeout)
