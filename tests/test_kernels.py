import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg.functions import kernels
from thalweg.streaming import incremental

BASINS = [(1, 7200.0, 1e6), (2, 14400.0, 5e6), (3, 3600.0, 2e5)]


@pytest.fixture(scope="module")
def basins(spark):
    return spark.createDataFrame(BASINS, "river_id long, tc double, area double")


def arrays(df, value):
    return {r["river_id"]: np.array(r[value]) for r in df.collect()}


@pytest.mark.parametrize("shape", list(kernels.TABLES))
def test_volume_is_conserved_and_lengths_are_shared(basins, shape):
    found = arrays(kernels.packed(kernels.kernel(basins, 3600, shape), "step", "u", "kernel"), "kernel")
    assert len({len(k) for k in found.values()}) == 1
    for river, _, area in BASINS:
        assert np.isclose(found[river].sum() * 3600, area)
        assert (found[river] >= 0).all()


def test_an_impulse_gives_the_kernel_and_steps_equal_the_whole(spark, basins):
    k = kernels.packed(kernels.kernel(basins, 3600), "step", "u", "kernel")
    n = len(next(iter(arrays(k, "kernel").values())))
    rng = np.random.default_rng(123)
    series = {1: [1.0] + [0.0] * (n - 1), 2: rng.random(n).tolist(), 3: rng.random(n).tolist()}
    lateral = spark.createDataFrame([(r, v) for r, v in series.items()], "river_id long, v array<double>")
    whole, steps = kernels.convolve(lateral, k), kernels.convolve_incrementally(lateral, k)
    assert np.allclose(arrays(whole, "v")[1], arrays(k, "kernel")[1])
    for name in ("v", "state"):
        a, b = arrays(whole, name), arrays(steps, name)
        assert all(np.allclose(a[r], b[r], rtol=1e-12) for r in series)
    halves = [spark.createDataFrame([(r, v[s]) for r, v in series.items()], "river_id long, v array<double>") for s in (slice(0, 5), slice(5, None))]
    first = kernels.convolve(halves[0], k)
    second = kernels.convolve(halves[1], k, first.select("river_id", "state"))
    assert all(np.allclose(np.concatenate([arrays(first, "v")[r], arrays(second, "v")[r]]), arrays(whole, "v")[r]) for r in series)
    with pytest.raises(Exception, match="does not fit"):
        kernels.convolve(lateral, k, spark.createDataFrame([(1, [0.0])], "river_id long, state array<double>")).collect()


def test_bad_duration(basins):
    with pytest.raises(ValueError):
        kernels.kernel(basins, 0)


def test_a_stream_of_steps(spark, basins, tmp_path):
    k = kernels.packed(kernels.kernel(basins, 3600), "step", "u", "kernel").cache()
    rng = np.random.default_rng(1)
    v = rng.random((3, 6))
    for i, part in enumerate(((0, 3), (3, 6))):
        spark.createDataFrame([(r + 1, t, float(v[r, t])) for r in range(3) for t in range(*part)], "river_id long, t int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("river_id long, t int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.convolved(stream, k).writeStream.format("memory").queryName("convolved").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["river_id"], r["t"]): r["q"] for r in spark.table("convolved").collect()}
    kernel = arrays(k, "kernel")
    for r in range(3):
        want = np.convolve(v[r], kernel[r + 1])[:6]
        assert np.allclose([got[r + 1, t] for t in range(6)], want)


def test_blocks_equal_the_whole(spark):
    """A kernel of 2000 steps over 10000 hours: no row is longer than a block and a kernel; halves carry over; members stay apart."""
    rng = np.random.default_rng(5)
    k, v = rng.random(2000), rng.random(10_000)
    own = spark.createDataFrame([(7, k.tolist()), (8, [1.0, 0.5])], "river_id long, kernel array<double>")
    steps = lambda low, high: spark.createDataFrame(pd.DataFrame({"river_id": np.repeat([7, 8], high - low), "t": np.tile(np.arange(high - low), 2), "v": np.tile(v[low:high], 2)}))
    found = kernels.convolve_blocks(steps(0, 10_000), own, block=2500).cache()
    assert found.agg(F.max(F.size("v"))).first()[0] == 2500 and found.where("state IS NOT NULL").count() == 2
    got = {(r["river_id"], r["t"]): r["v"] for r in kernels.by_step(found).collect()}
    want = {7: np.convolve(v, k), 8: np.convolve(v, [1.0, 0.5])}
    assert len(got) == 20_000 and all(np.allclose([got[r, t] for t in range(10_000)], want[r][:10_000], rtol=1e-9) for r in want)
    first = kernels.convolve_blocks(steps(0, 3100), own).where("state IS NOT NULL").select("river_id", "state")
    rest = kernels.convolve_blocks(steps(3100, 10_000), own, first, block=2048).cache()
    got = {(r["river_id"], r["t"]): r["v"] for r in kernels.by_step(rest).collect()}
    ends = arrays(rest.where("state IS NOT NULL"), "state")
    for r in want:
        assert np.allclose([got[r, t] for t in range(6900)], want[r][3100:10_000], rtol=1e-9)
        assert np.allclose(ends[r], np.append(want[r][10_000:], 0.0), atol=1e-9)


def test_blocks_of_members_and_what_stops_them(spark, basins):
    k = kernels.packed(kernels.kernel(basins, 3600), "step", "u", "kernel").cache()
    rng = np.random.default_rng(9)
    v = {(r, m): rng.random(70).tolist() for r in (1, 2, 3) for m in "ab"}
    long = lambda series: spark.createDataFrame([(r, m, t, x) for (r, m), s in series.items() for t, x in enumerate(s)], "river_id long, member string, t int, v double")
    found = kernels.convolve_blocks(long(v), k, keys=("river_id", "member"), block=16)
    got = {(r["river_id"], r["member"], r["t"]): r["v"] for r in kernels.by_step(found, "river_id", "member").collect()}
    own = arrays(k, "kernel")
    assert all(np.allclose([got[r, m, t] for t in range(70)], np.convolve(s, own[r])[:70]) for (r, m), s in v.items())
    rows = long({(1, "a"): v[1, "a"]}).drop("member")
    nothing = {r["t"]: r["v"] for r in kernels.by_step(kernels.convolve_blocks(rows.withColumn("v", F.when(F.col("t") == 3, F.lit(float("nan"))).when(F.col("t") != 5, F.col("v"))), k)).collect()}
    holes = [0.0 if t in (3, 5) else x for t, x in enumerate(v[1, "a"])]
    assert np.allclose([nothing[t] for t in range(70)], np.convolve(holes, own[1])[:70])
    assert kernels.convolve_blocks(rows.limit(0), k).count() == 0
    for bad, error in (
        (rows.where("t <> 20"), "missing or repeated"), (rows.where("t < 32 OR t >= 48"), "missing or repeated"), (rows.where("t >= 16"), "missing or repeated"),
        (rows.union(rows.where("t = 4")), "missing or repeated"), (rows.withColumn("river_id", F.lit(99).cast("long")), "no kernel"),
    ):
        with pytest.raises(Exception, match=error):
            kernels.convolve_blocks(bad, k, block=16).collect()
    with pytest.raises(Exception, match="does not fit"):
        kernels.convolve_blocks(rows, k, spark.createDataFrame([(1, [0.0])], "river_id long, state array<double>")).collect()


def test_rows_packed_in_parts_are_whole(spark, monkeypatch):
    """Rows in any order, in order, and by step, packed a few at a time: the arrays are those of all rows at once. Nulls and repeated steps stay."""
    rng = np.random.default_rng(8)
    rows = [(r, m, t, None if t == 3 else float(rng.integers(100))) for r in range(6) for m in ("a", "b", None) for t in range(30)] + [(2, "a", 5, -1.0)]
    for order in (rng.permutation(len(rows)).tolist(), range(len(rows)), sorted(range(len(rows)), key=lambda i: rows[i][2])):
        df = spark.createDataFrame([rows[i] for i in order], "river_id long, member string, t int, v double").repartition(3)
        for pack in (50, 1 << 20):
            monkeypatch.setattr(kernels, "PACK", pack)
            got = {(r["river_id"], r["member"]): r["v"] for r in kernels.packed_rows(df, "member").collect()}
            assert got == {(r["river_id"], r["member"]): r["v"] for r in kernels.packed(df, "t", "v", "v", "river_id", "member").collect()} and len(got) == 18
