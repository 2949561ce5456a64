import threading

import pytest
from pyspark.sql import functions as F

from thalweg.operators import network
from thalweg.plans.routers import RapidMuskingum
from thalweg.sources import cache, views


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("cached")
    views.net(spark, sf).write.parquet(str(d / "params"))
    views.qlateral(spark, sf).where("t < 6").withColumnRenamed("v", "qlateral").write.parquet(str(d / "q"))
    return d


def jobs(spark, run):
    """What a call gives, and how many jobs it starts."""
    group = f"counted-{threading.get_ident()}-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_second_run_starts_no_job_for_the_network(spark, files, monkeypatch):
    options = {"params_file": str(files / "params"), "qlateral_files": str(files / "q"), "log": False, "network_cache_dir": str(files / "cache")}
    router = lambda k, **more: RapidMuskingum(spark, discharge_files=[str(files / f"out-{k}")], **options | more)
    plain = router(0, network_cache_dir=None).route()
    assert jobs(spark, router(1).network)[1] > 0
    net, n = jobs(spark, router(2).network)
    assert n == 0 and {"watershed_id", "dist", "fed"} <= set(net.columns)
    monkeypatch.setattr(network, "rooted", None)  # not called any more
    again = router(3).route()
    read = lambda k: {(r["river_id"], r["time"]): r["Q"] for r in spark.read.parquet(str(files / f"out-{k}")).collect()}
    assert read(0) == read(3) and plain.state.exceptAll(again.state).isEmpty()
    assert [x[0] for x in cache.catalogue(str(files / "cache"))] == ["network"]


def test_changed_parameters_are_another_network(spark, files, tmp_path):
    path, folder = str(tmp_path / "params"), str(tmp_path / "cache")
    views_of = lambda k: spark.read.parquet(str(files / "params")).withColumn("k", F.col("k") * k)
    found = []
    for k in (1, 2):
        views_of(k).write.mode("overwrite").parquet(path)
        router = RapidMuskingum(spark, params_file=path, qlateral_files=str(files / "q"), discharge_files=[str(tmp_path / "out")], log=False, network_cache_dir=folder)
        found.append(router.network().agg(F.sum("k")).first()[0])
    assert found[1] == 2 * found[0]
    (_, a, size), (_, b, _) = cache.catalogue(folder)
    assert a != b and size > 0
    cache.forget(spark, folder, "network", a)
    assert [x[1] for x in cache.catalogue(folder)] == [b] and cache.catalogue(str(tmp_path / "nowhere")) == []


def test_wrong_parameters_are_not_kept(spark, files, tmp_path):
    spark.read.parquet(str(files / "params")).withColumn("k", F.lit(-1.0)).write.parquet(str(tmp_path / "params"))
    router = RapidMuskingum(spark, params_file=str(tmp_path / "params"), qlateral_files=str(files / "q"), discharge_files=[str(tmp_path / "out")], log=False, network_cache_dir=str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="k not positive"):
        router.network()
    assert cache.catalogue(str(tmp_path / "cache")) == []


def test_of_two_makers_the_first_stays(spark, tmp_path):
    """Another run publishes while this one makes the table."""
    folder = str(tmp_path / "cache")

    def make():
        cache.kept(spark, folder, "net", "k", lambda: spark.range(3))
        return spark.range(5)

    assert cache.kept(spark, folder, "net", "k", make).count() == 3
    assert [x[:2] for x in cache.catalogue(folder)] == [("net", "k")] and not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith(".net")]
