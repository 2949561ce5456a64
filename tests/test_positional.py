"""Files without ids, made here as other programs lay them out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg.plans.routers import RapidMuskingum, UnitMuskingum
from thalweg.sources import io, positional


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    """Ids in no order of theirs, over three files; each flows to the next."""
    folder = tmp_path_factory.mktemp("net")
    ids = [40, 10, 77, 5, 60, 31, 8]
    for k, part in enumerate(([0, 1, 2], [3], [4, 5, 6])):
        rows = {"river_id": [ids[i] for i in part], "downstream_river_id": [ids[i + 1] if i < 6 else -1 for i in part], "k": [3600.0] * len(part), "x": [0.2] * len(part)}
        pd.DataFrame(rows).to_parquet(folder / f"part-{k}.parquet")
    return str(folder), ids


def saved(path, dense, layout, store=np.savez):
    """A sparse matrix as scipy would save it."""
    row, col = np.nonzero(dense) if layout != "csc" else np.nonzero(dense.T)[::-1]
    own = {"data": dense[row, col], "format": np.array(layout.encode()), "shape": np.array(dense.shape)}
    if layout == "coo":
        own |= {"row": row.astype(np.int32), "col": col.astype(np.int32)}
    else:
        major, minor = (row, col) if layout == "csr" else (col, row)
        own |= {"indices": minor.astype(np.int32), "indptr": np.searchsorted(major, np.arange(dense.shape[layout == "csc"] + 1)).astype(np.int32)}
    store(path, **own)


def test_positions_count_over_files(spark, net):
    path, ids = net
    got = {r["position"]: r["river_id"] for r in io.read_params(spark, path, position=True).collect()}
    assert [got[k] for k in range(7)] == ids and len(got) == 7
    assert io.read_params(spark, path).columns == ["river_id", "downstream_river_id", "k", "x"]


def test_states_meet_rivers_by_place(spark, net, tmp_path):
    path, ids = net
    own = io.read_params(spark, path, position=True)
    pd.DataFrame({"Q": np.arange(7) * 1.5}).to_parquet(tmp_path / "state.parquet")
    got = {r["river_id"]: r["q"] for r in io.read_state(spark, str(tmp_path / "state.parquet"), own).collect()}
    assert got == {r: k * 1.5 for k, r in enumerate(ids)}
    for n in (6, 8, 0):
        pd.DataFrame({"Q": np.zeros(n)}).to_parquet(tmp_path / f"{n}.parquet")
        with pytest.raises(Exception, match="as many rows"):
            io.read_state(spark, str(tmp_path / f"{n}.parquet"), own).collect()
    with pytest.raises(ValueError, match="no positions"):
        io.read_state(spark, str(tmp_path / "state.parquet"), own.drop("position"))
    pd.DataFrame({"Q": [0.0], "P": [0.0]}).to_parquet(tmp_path / "two.parquet")
    with pytest.raises(ValueError, match="one column"):
        io.read_state(spark, str(tmp_path / "two.parquet"), own)


@pytest.mark.parametrize(("layout", "store"), [("csr", np.savez), ("csc", np.savez_compressed), ("coo", np.savez_compressed), ("csc", np.savez)])
def test_sparse_kernels(spark, net, tmp_path, monkeypatch, layout, store):
    """Small ranges and pieces, so that rows and columns begin and end anywhere in them; rivers without entries, and two archives."""
    monkeypatch.setattr(positional, "ENTRIES", 5)
    path, ids = net
    own = io.read_params(spark, path, position=True)
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((12, 7)) < 0.5, rng.random((12, 7)), 0.0)
    dense[:, 2] = 0.0
    (tmp_path / "k").mkdir()
    saved(tmp_path / "k/a.npz", dense[:, :4], layout, store)
    saved(tmp_path / "k/b.npz", dense[:, 4:], layout, store)
    got = {r["river_id"]: r["kernel"] for r in io.read_kernel(spark, str(tmp_path / "k"), own).collect()}
    assert got == {r: dense[:, k].tolist() for k, r in enumerate(ids)}
    with pytest.raises(ValueError, match="do not fit"):
        io.read_kernel(spark, str(tmp_path / "k/a.npz"), own)
    saved(tmp_path / "k/c.npz", dense[:5], layout, store)
    with pytest.raises(ValueError, match="one length"):
        io.read_kernel(spark, str(tmp_path / "k"), own)


def test_pieces_of_arrays(tmp_path, monkeypatch):
    """Every range of entries, with pieces of two numbers."""
    monkeypatch.setattr(positional, "PIECE", 2)
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((5, 6)) < 0.4, rng.random((5, 6)), 0.0)
    for layout in ("csr", "csc", "coo"):
        saved(tmp_path / f"{layout}.npz", dense, layout, np.savez_compressed)
        with positional.Archive(str(tmp_path / f"{layout}.npz")) as a:
            n = a.about()[3]
            for low in range(n):
                for high in range(low + 1, n + 1):
                    found = [x for part in a.entries(layout, low, high) for x in zip(*part, strict=True)]
                    assert len(found) == high - low and all(dense[i, j] == u for i, j, u in found)


def test_repeated_entries_are_summed(spark, net, tmp_path):
    path, ids = net
    np.savez(tmp_path / "k.npz", row=np.array([0, 0, 2]), col=np.array([1, 1, 6]), data=np.array([1.0, 2.0, 4.0]), format=np.array(b"coo"), shape=np.array([3, 7]))
    got = {r["river_id"]: r["kernel"] for r in io.read_kernel(spark, str(tmp_path / "k.npz"), io.read_params(spark, path, position=True)).collect()}
    assert got[ids[1]] == [3.0, 0.0, 0.0] and got[ids[6]] == [0.0, 0.0, 4.0] and got[ids[0]] == [0.0] * 3


def test_a_router_over_files_without_ids(spark, net, tmp_path):
    """State, kernels and carry-over by position give what the same with ids gives; order is asked for where it is needed."""
    path, ids = net
    rng = np.random.default_rng(6)
    times = pd.date_range("2024-01-01", periods=8, freq="h")
    pd.DataFrame({"river_id": np.repeat(ids, 8), "time": np.tile(times, 7), "qlateral": rng.random(56)}).to_parquet(tmp_path / "q.parquet", coerce_timestamps="us")
    dense, q, carry = rng.random((4, 7)), rng.random(7), rng.random((7, 4))
    saved(tmp_path / "kernel.npz", dense, "csr")
    pd.DataFrame({"Q": q}).to_parquet(tmp_path / "state.parquet")
    pd.DataFrame(carry, columns=[str(k) for k in range(4)]).to_parquet(tmp_path / "carry.parquet")
    spark.createDataFrame([(r, s, float(dense[s, k])) for k, r in enumerate(ids) for s in range(4)], "river_id long, step int, u double").write.parquet(str(tmp_path / "kernel"))
    spark.createDataFrame([(r, float(q[k])) for k, r in enumerate(ids)], "river_id long, Q double").write.parquet(str(tmp_path / "state"))
    spark.createDataFrame([(r, carry[k].tolist()) for k, r in enumerate(ids)], "river_id long, state array<double>").write.parquet(str(tmp_path / "carry"))
    found = []
    for end, more in ((".parquet", {"params_in_order": True}), ("", {})):
        kernel = "kernel.npz" if end else "kernel"
        out = str(tmp_path / f"out{end}")
        UnitMuskingum(
            spark, params_file=path, qlateral_files=str(tmp_path / "q.parquet"), discharge_files=[out], uh_kernel_file=str(tmp_path / kernel), channel_state_init_file=str(tmp_path / f"state{end}"), uh_state_init_file=str(tmp_path / f"carry{end}"), log=False, **more
        ).route()
        found.append({(r["river_id"], r["time"]): r["Q"] for r in spark.read.parquet(out).collect()})
    assert found[0] == found[1] and len(found[0]) == 56
    spark.read.parquet(path).orderBy(F.desc("river_id")).coalesce(1).write.parquet(str(tmp_path / "unordered"))
    with pytest.raises(ValueError, match="not before its downstream"):
        RapidMuskingum(spark, params_file=str(tmp_path / "unordered"), params_in_order=True, qlateral_files=str(tmp_path / "q.parquet"), discharge_files=[str(tmp_path / "no")], log=False).route()


def test_small_archives_share_tasks(spark, tmp_path):
    """Archives of a river each, one of them without entries: their headers are read by tasks, and there are not as many tasks as archives."""
    n = 40
    spark.createDataFrame([(100 + k, -1, 3600.0, 0.2) for k in range(n)], "river_id long, downstream_river_id long, k double, x double").coalesce(1).write.parquet(str(tmp_path / "net"))
    own = io.read_params(spark, str(tmp_path / "net"), position=True)
    (tmp_path / "k").mkdir()
    for k in range(n):
        saved(tmp_path / f"k/{k:03d}.npz", np.array([[float(k)], [0.0], [k + 0.5 if k != 7 else 0.0]]) * (k != 7), "csc")
    about = positional.headers(spark, positional.npz_files(str(tmp_path / "k")))
    assert about.rdd.getNumPartitions() == 1 and [(r["k"], r["rivers"], r["entries"]) for r in about.orderBy("k").collect()] == [(k, 1, 0 if k == 7 else 1 if k == 0 else 2) for k in range(n)]
    got = {r["river_id"]: r["kernel"] for r in io.read_kernel(spark, str(tmp_path / "k"), own).collect()}
    assert got == {100 + k: [float(k), 0.0, k + 0.5] if k != 7 else [0.0] * 3 for k in range(n)}


def test_kernels_are_not_broadcast(spark, net, tmp_path, monkeypatch):
    """Neither written nor read kernels pass through the driver, however small Spark takes them for; kernels are made by all cores."""
    from thalweg.functions import kernels

    path, ids = net
    own = io.read_params(spark, path, position=True)
    made = kernels.kernel(spark.createDataFrame([(r, 3600.0, 1e6) for r in ids], "river_id long, tc double, area double"), 3600)
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shown, collect = [], type(own).collect
    plan = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    monkeypatch.setattr(type(own), "collect", lambda df: (shown.append(plan(df)), collect(df))[1])
    small = spark.createDataFrame([(r, 3600.0, 1e6) for r in ids], "river_id long, tc double, area double")
    small.write.parquet(str(tmp_path / "basins"))
    positional.write_kernels(kernels.kernel(spark.read.parquet(str(tmp_path / "basins")), 3600), own, str(tmp_path / "k"), 2)
    shown.append(plan(io.read_kernel(spark, str(tmp_path / "k"), own)))
    merged = [p for p in shown if "SortMergeJoin" in p]
    assert len(merged) == 2
