import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thalweg.functions import kernels
from thalweg.operators import network
from thalweg.plans import cli
from thalweg.plans.config import Config
from thalweg.plans.routers import Muskingum, RapidMuskingum, UnitMuskingum
from thalweg.sources import io, views

HOURS = 24


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    views.net(spark, sf).write.parquet(str(d / "params.parquet"))
    views.state(spark, sf).select("river_id", F.col("q").alias("Q")).write.parquet(str(d / "state.parquet"))
    q = views.qlateral(spark, sf).withColumnRenamed("v", "qlateral")
    q.where(f"t < {HOURS}").write.parquet(str(d / "a.parquet"))
    q.where(f"t >= {HOURS} AND t < {2 * HOURS}").write.parquet(str(d / "b.parquet"))
    q.where(f"t < {2 * HOURS}").write.parquet(str(d / "whole.parquet"))
    io.write_weights(views.weights(spark, sf), str(d / "weights.parquet"))
    g = views.grid(spark, sf).where("t < 6")
    io.with_dates(g, "2024-01-01", 3600).drop("t").write.parquet(str(d / "grid.parquet"))
    io.write_kernel(kernels.kernel(views.uh_inputs(spark, sf), 3600, "triangular"), str(d / "kernel.parquet"))
    (d / "out").mkdir()
    return d


def read(spark, path):
    return {(r["river_id"], r["time"]): r["Q"] for r in spark.read.parquet(str(path)).collect()}


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)


def options(files, **more):
    return {"params_file": str(files / "params.parquet"), "discharge_dir": str(files / "out"), "log": False} | more


def test_sequential_pieces_equal_the_whole(spark, files):
    state = str(files / "final.parquet")
    r = RapidMuskingum(spark, **options(files, qlateral_files=[str(files / "a.parquet"), str(files / "b.parquet")], channel_state_final_file=state)).route()
    RapidMuskingum(spark, **options(files, qlateral_files=str(files / "whole.parquet"))).route()
    pieces = read(spark, files / "out/discharge_a.parquet") | read(spark, files / "out/discharge_b.parquet")
    assert near(pieces, read(spark, files / "out/discharge_whole.parquet"))
    assert (1, datetime(2024, 1, 2, 23)) in pieces
    assert io.read_state(spark, state, r.net).join(r.state.withColumnRenamed("q", "p"), "river_id").where("abs(p - q) > 1e-12").isEmpty()
    assert spark.read.parquet(str(files / "out/discharge_a.parquet")).schema["Q"].dataType.typeName() == "float"


def test_ensembles_start_alike_and_end_with_the_mean(spark, files):
    same = [str(files / "a.parquet"), str(files / "a.parquet")]
    r = RapidMuskingum(spark, **options(files, discharge_dir=None, discharge_files=[str(files / "out/m1"), str(files / "out/m2")], qlateral_files=same, runoff_processing_mode="ensemble")).route()
    one = RapidMuskingum(spark, **options(files, qlateral_files=same[0])).route()
    assert near(read(spark, files / "out/m1"), read(spark, files / "out/m2"))
    assert r.state.join(one.state.withColumnRenamed("q", "p"), "river_id").where("abs(p - q) > 1e-12").isEmpty()


def test_output_steps_and_a_sink_of_ones_own(spark, files):
    seen = []
    router = RapidMuskingum(spark, **options(files, qlateral_files=str(files / "a.parquet"), dt_discharge=6 * 3600, dt_routing=900))
    router.set_write_discharges(io.selected_rivers(lambda df, path, source: seen.append((df.count(), df.select("river_id").distinct().count(), path, source)), [1, 3])).route()
    assert seen == [(8, 2, str(files / "out/discharge_a.parquet"), str(files / "a.parquet"))]


def test_the_first_step_holds_throughout(spark, files):
    """Times 0, 1 and 3 hours: no step fits them all."""
    gaps = str(files / "gaps.parquet")
    spark.read.parquet(str(files / "a.parquet")).where("t IN (0, 1, 3)").write.parquet(gaps)
    with pytest.raises(ValueError, match="3600 s apart"):
        RapidMuskingum(spark, **options(files, qlateral_files=gaps)).route()


def test_roots_are_found_once(spark, files, monkeypatch):
    """Not again for each input."""
    calls, found = [], network.rooted
    monkeypatch.setattr(network, "rooted", lambda net: calls.append(1) or found(net))
    RapidMuskingum(spark, **options(files, qlateral_files=[str(files / "a.parquet"), str(files / "b.parquet")])).route()
    assert len(calls) == 1


def test_channel_only(spark, files):
    Muskingum(spark, **options(files, channel_state_init_file=str(files / "state.parquet"), dt_routing=1800, dt_discharge=3600, dt_total=6 * 3600, start_datetime="2020-02-28 20:00:00")).route()
    q = read(spark, files / "out/discharge.parquet")
    assert min(t for _, t in q) == datetime(2020, 2, 28, 20) and max(t for _, t in q) == datetime(2020, 2, 29, 1) and min(q.values()) >= 0
    with pytest.raises(ValueError, match="dt_routing"):
        Muskingum(spark, **options(files, channel_state_init_file=str(files / "state.parquet")))


def test_unit_router_from_a_grid(spark, files):
    carry = str(files / "carry.parquet")
    UnitMuskingum(spark, **options(files, grid_runoff_files=str(files / "grid.parquet"), grid_weights_file=str(files / "weights.parquet"), uh_kernel_file=str(files / "kernel.parquet"), uh_state_final_file=carry)).route()
    assert min(read(spark, files / "out/discharge_grid.parquet").values()) >= 0
    again = UnitMuskingum(spark, **options(files, grid_runoff_files=str(files / "grid.parquet"), grid_weights_file=str(files / "weights.parquet"), uh_kernel_file=str(files / "kernel.parquet"), uh_state_init_file=carry))
    again.route()


def test_configuration(files, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"_router": "RapidMuskingum"} | options(files, qlateral_files=str(files / "a.parquet"))))
    c = Config.load(str(path), dt_routing=60)
    assert c.dt_routing == 60 and c.qlateral_files == [str(files / "a.parquet")] and not c.progress_bar
    yaml = tmp_path / "c.yaml"
    yaml.write_text(f"params_file: {files}/params.parquet\ndischarge_dir: {files}/out\ngrid_runoff_files: null\n")
    assert Config.load(str(yaml)).grid_runoff_files == []
    for bad, error in (
        ({"runoff_processing_mode": "both"}, ValueError), ({"params_file": "nowhere"}, FileNotFoundError), ({"discharge_dir": None}, ValueError), ({"discharge_files": ["x"]}, ValueError),
        ({"discharge_dir": str(tmp_path / "no")}, NotADirectoryError), ({"colour": 1}, TypeError), ({"params_file": None}, ValueError),
    ):
        with pytest.raises(error):
            Config.load(**(options(files) | bad))
    with pytest.raises(RuntimeError):
        Config.load(str(tmp_path / "c.txt"))


def test_command_line(spark, files, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(options(files, qlateral_files=str(files / "a.parquet"), strategy="levels")))
    assert cli.main(["route", "--router", "RapidMuskingum", str(path)], spark) == 0
    assert cli.main([], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["route", "--router", "None", str(path)], spark)


def test_unit_ensembles_and_kernel_steps(spark, files, tmp_path):
    """Members of one step are convolved and routed together, each from the same carry-over; kernels of other steps stop the run."""
    kernel = spark.read.parquet(str(files / "kernel.parquet"))
    io.write_kernel(kernel, str(tmp_path / "hour"), 3600)
    io.write_kernel(kernel, str(tmp_path / "day"), 86400)
    own = options(files, discharge_dir=None, uh_kernel_file=str(tmp_path / "hour"))
    outs = [str(tmp_path / k) for k in ("qa", "qb")]
    UnitMuskingum(spark, **own | {"discharge_files": outs, "qlateral_files": [str(files / "a.parquet"), str(files / "b.parquet")], "runoff_processing_mode": "ensemble"}).route()
    for k, out in zip("ab", outs, strict=True):
        UnitMuskingum(spark, **own | {"discharge_files": [str(tmp_path / f"one-{k}")], "qlateral_files": [str(files / f"{k}.parquet")]}).route()
        assert near(read(spark, out), read(spark, tmp_path / f"one-{k}"))
    with pytest.raises(ValueError, match="86400 s do not fit"):
        UnitMuskingum(spark, **own | {"uh_kernel_file": str(tmp_path / "day"), "discharge_files": outs[:1], "qlateral_files": [str(files / "a.parquet")]}).route()


def test_unit_router_in_chunks_of_time(spark, files, tmp_path):
    """Two inputs: convolved in blocks and routed in chunks, the carry-over passed on, as whole."""
    own = options(files, uh_kernel_file=str(files / "kernel.parquet"), discharge_dir=None, qlateral_files=[str(files / "a.parquet"), str(files / "b.parquet")])
    ends = {}
    for strategy in ("grouped", "chunks"):
        outs = [str(tmp_path / f"{strategy}-{k}") for k in "ab"]
        ends[strategy] = UnitMuskingum(spark, **own | {"strategy": strategy, "discharge_files": outs}).route().carry
    for k in "ab":
        assert near(read(spark, tmp_path / f"grouped-{k}"), read(spark, tmp_path / f"chunks-{k}"))
    a, b = ({r["river_id"]: r["state"] for r in df.collect()} for df in ends.values())
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for r in a for x, y in zip(a[r], b[r], strict=True))
