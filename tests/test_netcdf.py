"""netCDF files: layouts made by hand, blocks that are read and spared, files written by several tasks."""

import os
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.sources import io, netcdf

START = datetime(2024, 1, 1)


def made_by_hand(version: int, records: bool) -> bytes:
    """time (5), y (2), x (3): ro packed in 16 bits with a fill value, and a second variable on time, so that records hold two."""
    count, place = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda s: struct.pack(count, len(s)) + pad(s.encode())
    text = lambda k, v: name(k) + struct.pack(">i", 2) + struct.pack(count, len(v)) + pad(v.encode())
    double = lambda k, v: name(k) + struct.pack(">i", 6) + struct.pack(count, 1) + struct.pack(">d", v)
    short = lambda k, v: name(k) + struct.pack(">i", 3) + struct.pack(count, 1) + pad(struct.pack(">h", v))
    some = lambda tag, parts: struct.pack(">i", tag if parts else 0) + struct.pack(count, len(parts)) + b"".join(parts)
    time = (np.arange(5) * 6).astype(">i4")
    ro = np.arange(30, dtype=">i2").reshape(5, 2, 3)
    ro[2, 1, 1] = -1
    variables = [
        ("time", [0], 4, [text("units", "hours since 2024-1-1 00:00:0.0")], time),
        ("x", [2], 5, [], np.array([10, 20, 30], ">f4")),
        ("ro", [0, 1, 2], 3, [double("scale_factor", 0.5), double("add_offset", 100.0), short("_FillValue", -1)], ro),
        ("level", [0], 3, [], np.array([7, 8, 9, 10, 11], ">i2")),
    ]
    fixed = [v for v in variables if not (records and v[1][0] == 0)]
    grows = [v for v in variables if records and v[1][0] == 0]

    def header(begins):
        dims = [name("time") + struct.pack(count, 0 if records else 5), name("y") + struct.pack(count, 2), name("x") + struct.pack(count, 3)]
        own = []
        for n, dim, kind, about, values in variables:
            size = len(pad(values[:1].tobytes() if records and dim[0] == 0 else values.tobytes()))
            own.append(name(n) + struct.pack(count, len(dim)) + b"".join(struct.pack(count, i) for i in dim) + some(12, about) + struct.pack(">i", kind) + struct.pack(count, size) + struct.pack(place, begins.get(n, 0)))
        return b"CDF" + bytes([version]) + struct.pack(count, 5 if records else 0) + some(10, dims) + some(12, [text("title", "by hand")]) + some(11, own)

    body, begins, at = b"", {}, len(header({}))
    for n, _, _, _, values in fixed:
        begins[n] = at + len(body)
        body += pad(values.tobytes())
    for r in range(5 if records else 0):
        for n, _, _, _, values in grows:
            begins.setdefault(n, at + len(body))
            body += pad(values[r : r + 1].tobytes())
    return header(begins) + body


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("records", [False, True])
def test_layouts(spark, tmp_path, version, records):
    path = str(tmp_path / "a.nc")
    with open(path, "wb") as f:
        f.write(made_by_hand(version, records))
    found = netcdf.read(spark, [path], "time timestamp_ntz, x_index int, y int, ro double, x double, source string", block=6).orderBy("time", "y", "x").collect()
    assert len(found) == 30
    for k, r in enumerate(found):
        assert (r.time, r.y, r.x_index, r.x, r.source) == (START + timedelta(hours=6 * (k // 6)), k // 3 % 2, k % 3, 10.0 * (k % 3 + 1), path)
        assert np.isnan(r.ro) if k == 16 else r.ro == 100 + k / 2
    assert [tuple(r) for r in netcdf.read(spark, [path], "time_index int, level long").orderBy("time_index").collect()] == [(k, 7 + k) for k in range(5)]
    assert [r.x for r in netcdf.read(spark, [path], "x float").collect()] == [10, 20, 30]
    assert spark.read.format("netcdf").load(path).columns == ["time", "y", "x", "ro"]
    with pytest.raises(Exception, match="different dimensions"):
        netcdf.read(spark, [path], "ro double, level long").collect()
    with pytest.raises(Exception, match="neither a variable nor a dimension"):
        netcdf.read(spark, [path], "ro double, nothing long").collect()


def series(spark, steps, rivers):
    t = spark.range(steps * rivers).select((F.col("id") % steps).cast("int").alias("t"), (1000 + F.floor(F.col("id") / steps) * 7).alias("river_id"))
    return io.with_dates(t, START, 3600).withColumn("q", F.col("t") * 1000 + F.col("river_id") / 8).drop("t")


def test_only_blocks_asked_for_are_opened(spark, tmp_path):
    path = str(tmp_path / "q.nc")
    netcdf.write(series(spark, 48, 10), path, {"time": "time", "river_id": "long"}, {"q": "double"})
    schema, day = "time timestamp_ntz, river_id long, q double", START + timedelta(hours=24)
    whole = netcdf.read(spark, [path], schema, block=40)
    part = netcdf.read(spark, [path], schema, day, day + timedelta(hours=8), block=40)
    assert whole.rdd.getNumPartitions() == 12 and part.rdd.getNumPartitions() == 2 and part.count() == 80
    assert part.exceptAll(whole.where((F.col("time") >= day) & (F.col("time") < day + timedelta(hours=8)))).isEmpty()
    # A step wider than a block is cut itself.
    narrow = netcdf.read(spark, [path], schema, block=7)
    assert narrow.rdd.getNumPartitions() == 48 * 10 // 7 + 1 and narrow.exceptAll(whole).isEmpty()
    spark.conf.set(netcdf.PUSHDOWN, "true")
    try:
        pushed = netcdf.read(spark, [path], schema, block=40).where((F.col("time") >= F.lit(day)) & (F.col("time") < F.lit(day + timedelta(hours=4))))
        assert pushed.rdd.getNumPartitions() == 1 and pushed.count() == 40
        assert netcdf.read(spark, [path], f"{schema}, time_index int", block=40).where("time_index = 9").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(netcdf.PUSHDOWN)


def test_written_by_several_tasks(spark, tmp_path):
    q, path = series(spark, 60, 37).repartition(5), str(tmp_path / "q.nc")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would go to one task
    try:
        io.write_discharge(q, path, "in.nc")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert os.listdir(tmp_path) == ["q.nc"]
    back = netcdf.read(spark, [path], "time timestamp_ntz, river_id long, Q float")
    assert back.exceptAll(q.select("time", "river_id", F.col("q").cast("float"))).isEmpty() and back.count() == 60 * 37
    with open(path, "rb") as f:
        raw = f.read()
    system, at = netcdf.located(path)
    with system.open_input_file(at) as f:
        header = netcdf.parsed(f)
    v = header.variables["Q"]
    assert header.dims == {"time": 60, "river_id": 37} and v.attributes["units"] == "m3 s-1" and header.attributes["runoff_file"] == "in.nc"
    assert header.variables["time"].attributes["units"] == "seconds since 2024-01-01 00:00:00"
    assert np.frombuffer(raw, ">f8", 60, header.variables["time"].begin).tolist() == [3600.0 * k for k in range(60)]
    # Written again, the new file takes the place of the old one.
    io.write_discharge(q.where("river_id = 1000"), path)
    assert netcdf.read(spark, [path], "time timestamp_ntz, river_id long, Q float").count() == 60


def test_incomplete_cubes_leave_nothing(spark, tmp_path):
    q = series(spark, 10, 4)
    for bad, said in ((q.where("q <> 1000"), "got"), (q.where("NOT (river_id = 1007 AND q > 5000)"), "got 36|got 35|got 34|got"), (q.union(q.limit(1)), "twice|got 41")):
        rows = bad.count()
        if rows == 40:
            continue
        with pytest.raises(Exception, match=said):
            netcdf.write(bad, str(tmp_path / "bad.nc"), {"time": "time", "river_id": "long"}, {"q": "double"})
        assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="classic layout"):
        (tmp_path / "h5.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
        netcdf.read(spark, [str(tmp_path / "h5.nc")], "q double").collect()


def test_empty_and_missing_values(spark, tmp_path):
    path, dims = str(tmp_path / "e.nc"), {"time": "time", "river_id": "long"}
    q = series(spark, 3, 2)
    netcdf.write(q.where("false"), path, dims, {"q": "double"})
    assert netcdf.read(spark, [path], "time timestamp_ntz, river_id long, q double").count() == 0
    netcdf.write(q.withColumn("q", F.when(F.col("river_id") == 1000, F.col("q"))), path, dims, {"q": "double"})
    found = netcdf.read(spark, [path], "river_id long, q double").collect()
    assert all(np.isnan(r.q) == (r.river_id != 1000) for r in found) and len(found) == 6


def test_folders_and_inputs_apart(spark, tmp_path):
    """Inputs of both kinds, told apart by their paths; blanks and percent signs in names."""
    q = series(spark, 4, 2)
    (tmp_path / "nc").mkdir()
    for k in (1, 2):
        netcdf.write(q.withColumn("q", F.col("q") * k), str(tmp_path / f"nc/{k}.nc"), {"time": "time", "river_id": "long"}, {"q": "double"})
    assert netcdf.read(spark, [str(tmp_path / "nc")], "q double").count() == 16
    paths = [str(tmp_path / n) for n in ("sp ace", "per%20cent+x", "sp ace 2")] + [str(tmp_path / "nc/1.nc")]
    for k, p in enumerate(paths[:3]):
        q.withColumn("q", F.lit(float(k))).write.parquet(p)
    found = io.read_series(spark, paths, "q").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).collect()
    assert {r.source: r.n for r in found} == {p: 8 for p in paths}
    assert [{r.source: r.m for r in found}[p] for p in paths[:3]] == [0, 1, 2]
