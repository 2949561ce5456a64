from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thalweg.operators.network import with_roots
from thalweg.plans.routers import RapidMuskingum
from thalweg.sources import store, views

HOURS = 96


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """A thousand rivers over 64 files: some fifteen to a file."""
    sf, d = "/root/testdata/sf0.1", tmp_path_factory.mktemp("store")
    net = with_roots(views.net(spark, sf)).cache()
    q = views.qlateral(spark, sf).where(f"t < {HOURS}").select("river_id", "time", F.col("v").alias("q")).cache()
    store.write(q, net, str(d / "q"), 64)
    return str(d / "q"), net, q


def rows(df):
    return sorted(map(tuple, df.select("river_id", "time", "q").collect()))


def test_a_river_lies_in_few_files(spark, clustered):
    path, net, q = clustered
    assert store.manifest(spark, path).agg(F.sum("n")).first()[0] == q.count() and store.manifest(spark, path).count() > 50
    for river in range(1, 1001, 91):
        found = store.read(spark, path, net, [river])
        assert 1 <= len(found.inputFiles()) <= 2
        assert rows(found) == rows(q.where(F.col("river_id") == river))
    assert rows(store.read(spark, path)) == rows(q)


def test_rivers_and_times_together(spark, clustered):
    path, net, q = clustered
    low = datetime(2024, 1, 1) + timedelta(hours=10)
    high = low + timedelta(hours=5)
    found = store.read(spark, path, net, [1, 2, 5], low, high)
    assert rows(found) == rows(q.where(F.col("river_id").isin(1, 2, 5) & (F.col("time") >= F.lit(low)) & (F.col("time") < F.lit(high))))
    assert store.read(spark, path, net, [10**9]).count() == 0 and store.read(spark, path, net, []).count() == 0
    assert store.read(spark, path, since=datetime(2030, 1, 1)).count() == 0
    with pytest.raises(ValueError, match="network"):
        store.read(spark, path, rivers=[1])


def test_rewriting_repeated_rows_and_strangers(spark, clustered, tmp_path):
    _, net, q = clustered
    path = str(tmp_path / "again")
    few = q.where("river_id <= 4")
    store.write(few, net, path, 2)
    store.write(few.union(few.limit(3)), net, path, 3)
    assert store.read(spark, path).count() == few.count() + 3
    store.write(few.limit(0), net, path, 3)
    assert store.read(spark, path).count() == 0 and store.read(spark, path, net, [1]).count() == 0
    with pytest.raises(Exception, match="not in the network"):
        store.write(few.withColumn("river_id", F.lit(-5).cast("long")), net, path, 1)
    assert store.read(spark, path).count() == 0


def test_as_a_router_s_sink(spark, sf, tmp_path):
    net = with_roots(views.net(spark, sf))
    views.net(spark, sf).write.parquet(str(tmp_path / "params"))
    views.qlateral(spark, sf).where("t < 12").withColumnRenamed("v", "qlateral").write.parquet(str(tmp_path / "in"))
    router = lambda out: RapidMuskingum(spark, params_file=str(tmp_path / "params"), qlateral_files=str(tmp_path / "in"), discharge_files=[str(tmp_path / out)], log=False)
    router("plain").route()
    router("clustered").set_write_discharges(store.sink(net, 8)).route()
    plain = {(r["river_id"], r["time"]): r["Q"] for r in spark.read.parquet(str(tmp_path / "plain")).collect()}
    found = {(r["river_id"], r["time"]): r["q"] for r in store.read(spark, str(tmp_path / "clustered")).collect()}
    assert plain.keys() == found.keys() and all(abs(plain[k] - found[k]) <= 1e-6 * max(1, abs(found[k])) for k in plain)
