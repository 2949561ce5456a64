"""Streamed routing against routing at once: over restarts, of both kinds, and with steps that do not follow."""

import numpy as np
import pyarrow as pa
import pytest

from thalweg.functions import kernels
from thalweg.operators import routing
from thalweg.sources import views
from thalweg.streaming import routed as streaming
from thalweg.streaming.routed import routed

HOUR = 3600


@pytest.mark.parametrize("kind", ["rapid", "unit"])
def test_restarts_go_on_and_late_steps_stop(spark, sf, tmp_path, kind):
    net, state = views.net(spark, sf), views.state(spark, sf)
    lateral = views.qlateral(spark, sf).where("t < 12").select("river_id", "t", "v")

    def run(name, rows):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))
        stream = spark.readStream.schema(lateral.schema).parquet(f"{tmp_path}/in/*")
        save = lambda df, batch: df.write.mode("append").parquet(str(tmp_path / "out"))
        found = routed(stream, net, kind, HOUR, 2, state)
        found.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()

    run("a", lateral.where("t < 5"))
    run("b", lateral.where("t >= 5"))
    whole = routing.long_series(routing.route(kind, net, lateral, 12, HOUR, 2, state, strategy="grouped")).collect()
    got = {(r.river_id, r.t): r.q for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(whole) and all(np.isclose(got[r.river_id, r.t], r.q, rtol=1e-9, atol=1e-9) for r in whole)
    if kind == "rapid":
        with pytest.raises(Exception, match="came after 11"):
            run("late", lateral.where("t = 3"))


def test_incomplete_steps_stop(spark, sf, tmp_path):
    lateral = views.qlateral(spark, sf).where("t < 3 AND NOT (river_id = 5 AND t = 1)").select("river_id", "t", "v")
    lateral.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lateral.schema).parquet(str(tmp_path / "in"))
    query = routed(stream, views.net(spark, sf), "rapid", HOUR).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("noop").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="not complete"):
        query.awaitTermination()


def test_rows_are_packed_by_river(monkeypatch):
    """In any order, over several packs: nothing is lost or exchanged, and a river has few arrays."""
    rng = np.random.default_rng(5)
    river, t = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(50), indexing="ij"))
    order = rng.permutation(200)
    rows = pa.table({"river_id": river[order], "t": pa.array(t[order], pa.int32()), "v": (river * 1000.0 + t)[order]})
    monkeypatch.setattr(kernels, "PACK", 60)
    out = pa.Table.from_batches(kernels.runs(iter(rows.to_batches(max_chunksize=30)), "river_id")).to_pylist()
    assert len(out) == 4 * 4 and all(r["t"] == sorted(r["t"]) for r in out)
    assert sorted((r["river_id"], a, b) for r in out for a, b in zip(r["t"], r["v"], strict=True)) == [(int(r), int(k), r * 1000.0 + k) for r, k in zip(river, t, strict=True)]


def test_steps_of_a_batch_are_whole():
    """Numbers meet their river and step in any order; a missing, repeated or extra one stops the query."""
    rivers = np.array([3, 5, 9])
    river, t = np.array([9, 3, 5, 5, 3, 9]), np.array([7, 6, 7, 6, 7, 6])
    steps, found = streaming.matrix(1, rivers, river, t, river * 10.0 + t, 3)
    assert steps.tolist() == [6, 7] and found.tolist() == [[36.0, 37.0], [56.0, 57.0], [96.0, 97.0]]
    for bad in (t[:5], np.array([7, 6, 7, 7, 7, 6]), np.array([8, 6, 8, 6, 8, 6])):
        with pytest.raises(ValueError, match="not complete"):
            streaming.matrix(1, rivers, river[: len(bad)], bad, np.zeros(len(bad)), 3)
    with pytest.raises(ValueError, match="not complete"):
        streaming.matrix(1, rivers, river, t, river * 1.0, 4)
