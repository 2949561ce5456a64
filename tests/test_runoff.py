import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import geometry, metrics
from thalweg.operators import runoff, weights
from thalweg.sources import io, views


def area(ring):
    return float(geometry.areas(np.array(ring, float), np.zeros(len(ring), np.int64), 1)[0])


def series(df):
    return {(r["river_id"], r["t"]): r["v"] for r in df.collect()}


def test_cumulative_and_incremental_are_inverse(spark, sf):
    g, w = views.grid(spark, sf), views.weights(spark, sf)
    one = runoff.aggregate(g, w)
    a, b = series(one), series(runoff.to_incremental(runoff.to_cumulative(one)))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_missing_cells_make_a_step_nan_and_then_zero(spark):
    w = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.5)], "river_id long, x_index int, y_index int, proportion double")
    g = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 4.0), (1, 0, 0, None), (1, 1, 0, 4.0), (2, 0, 0, float("nan")), (2, 1, 0, 1.0)], "t int, x_index int, y_index int, ro double")
    raw = series(runoff.aggregate(g, w))
    assert raw[1, 0] == 3 and math.isnan(raw[1, 1]) and math.isnan(raw[1, 2])
    assert series(runoff.to_qlateral(g, w)) == {(1, 0): 3.0, (1, 1): 0.0, (1, 2): 0.0}


def test_resampling_drops_samples_off_the_grid(spark):
    rows = [(1, 0, 1.0), (1, 2, 2.0), (1, 3, 9.0), (1, 6, 4.0)]
    df = spark.createDataFrame(rows, "river_id long, t long, v double")
    assert not runoff.is_uniform(df)
    # Running sums 1, 3, (12 off the grid), 16 on the grid 0, 2, 4, 6: the value at 4 lies half way between 3 and 16.
    assert series(runoff.resample_uniform(df)) == {(1, 0): 1.0, (1, 2): 2.0, (1, 4): 6.5, (1, 6): 6.5}


def test_one_step_is_allowed(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "river_id long, t long, v double")
    assert series(runoff.resample_uniform(df)) == {(1, 0): 1.0}


def test_units(spark):
    assert runoff.unit_factor("mm") == 0.001 and runoff.unit_factor(None) == 1
    with pytest.raises(ValueError):
        runoff.unit_factor("feet")
    with pytest.raises(Exception, match="feet"):
        spark.createDataFrame([("feet",)], "u string").select(runoff.unit_factor_column(F.col("u"))).collect()


def test_overlay_splits_a_rectangle_exactly(spark, sf):
    c = weights.cells(*views.axes(spark, sf))
    w = weights.overlay(c, views.boxes(spark, sf)).cache()
    sums = w.groupBy("river_id").agg(F.sum("proportion").alias("p"), F.sum("area_sqm").alias("a")).collect()
    for r in sums:
        k = r["river_id"] - 1
        x0, y0 = k * 11.0 - 140, k * 4.0 - 50
        whole = area([[x0, y0], [x0 + 20, y0], [x0 + 20, y0 + 12], [x0, y0 + 12]])
        assert math.isclose(r["p"], 1, rel_tol=1e-9) and math.isclose(r["a"], whole, rel_tol=1e-9)
    with pytest.raises(KeyError):
        weights.overlay(c, views.boxes(spark, sf).drop("ring"))


def test_clip_keeps_what_is_inside():
    triangle = [[0, 0], [4, 0], [0, 4], [0, 0]]
    far, none = [[9, 9], [10, 9], [10, 10]], [[0, 0], [0, 0], [0, 0]]
    points, ring = geometry.clipped(np.array(triangle + far + none, float), np.repeat([0, 1, 2], [4, 3, 3]), np.array([[0, 1, 0, 1], [5, 6, 5, 6], [0, 1, 0, 1]], float))
    assert {tuple(p) for p in points[ring == 0]} == {(0, 0), (1, 0), (1, 1), (0, 1)} and not (ring == 1).any()
    # The whole ellipsoid's area: both hemispheres of the projection.
    assert math.isclose(area([[-180, -90], [180, -90], [180, 90], [-180, 90]]), 5.10065621724e14, rel_tol=1e-9)


def test_shapes_from_well_known_binary():
    parts = [[[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)]], [[(5.0, 5.0), (9.0, 5.0), (9.0, 9.0), (5.0, 5.0)], [(6.0, 5.5), (7.0, 5.5), (7.0, 6.0), (6.0, 5.5)]]]
    assert [[[tuple(p) for p in r] for r in rings] for rings in geometry.polygons(geometry.multipolygon(parts))] == parts
    # Big-endian, one polygon with heights.
    raw = struct.pack(">BIII", 0, 1003, 1, 3) + struct.pack(">9d", 0, 0, 7, 1, 0, 7, 1, 1, 7)
    assert geometry.polygons(raw)[0][0].tolist() == [[0, 0], [1, 0], [1, 1]]
    with pytest.raises(ValueError, match="neither"):
        geometry.polygons(struct.pack("<BI2d", 1, 1, 0, 0))


def test_overlay_of_slanted_shapes_covers_them(spark):
    """Triangles and a shape with a hole over a fine grid: cells' areas sum to the shapes', and weights come in order."""
    axis = lambda name: spark.range(40).select(F.col("id").cast("int").alias(f"{name}_index"), (F.col("id") * 0.5).alias(name))
    shapes = [[[(1.3, 2.1), (9.7, 3.4), (4.2, 11.9)]], [[(10.0, 10.0), (18.0, 10.0), (18.0, 18.0), (10.0, 18.0)], [(12.0, 12.0), (15.0, 12.5), (13.0, 16.0)]]]
    point = "struct<x:double,y:double>"
    catchments = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in enumerate(shapes)], f"river_id long, rings array<array<{point}>>")
    found = weights.overlay(weights.cells(axis("x"), axis("y")), catchments).collect()

    def dense(ring):
        """Edges are straight in degrees: with many points on them their chords follow the projection."""
        return [(a + (c - a) * k / 400, b + (d - b) * k / 400) for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True) for k in range(400)]

    for k, rings in enumerate(shapes):
        whole = area(dense(rings[0])) - sum(area(dense(r)) for r in rings[1:])
        assert math.isclose(sum(r["area_sqm"] for r in found if r["river_id"] == k), whole, rel_tol=1e-5)
    assert [(r["river_id"], -r["area_sqm"]) for r in found] == sorted((r["river_id"], -r["area_sqm"]) for r in found)


def test_numbers_and_nearest_lines(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 101).alias("a"), "id").repartition(7)
    got = {r["row"]: (r["a"], r["id"]) for r in weights.numbered(df, "a", "id").collect()}
    assert [got[i] for i in range(1, 501)] == sorted((i * 37 % 101, i) for i in range(500))
    axis = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "i int, v double")
    points = spark.createDataFrame([(-3.0,), (5.0,), (5.1,), (99.0,)], "x double")
    assert [r["near"] for r in weights.nearest(points, axis, "i", "v", "x", "near").orderBy("x").collect()] == [0, 0, 1, 2]


def test_metrics_guard_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 5.0), (2, 1.0, 2.0), (2, 1.0, 3.0)], "g int, t double, p double")
    got = {r["g"]: r for r in df.groupBy("g").agg(metrics.me(F.col("t"), F.col("p")).alias("me"), metrics.pearson_r(F.col("t"), F.col("p")).alias("r"), metrics.kge2012(F.col("t"), F.col("p")).alias("kge")).collect()}
    t, p = np.array([1, 2, 3.0]), np.array([2, 4, 5.0])
    assert math.isclose(got[1]["me"], (t - p).mean()) and math.isclose(got[1]["r"], np.corrcoef(t, p)[0, 1])
    beta, gamma = p.mean() / t.mean(), (p.mean() / p.std()) / (t.mean() / t.std())
    want = 1 - math.sqrt((np.corrcoef(t, p)[0, 1] - 1) ** 2 + (beta - 1) ** 2 + (gamma - 1) ** 2)
    assert math.isclose(got[1]["kge"], want)
    assert math.isnan(got[2]["r"]) and math.isnan(got[2]["kge"])


def test_weight_files(spark, sf, tmp_path):
    w = views.weights(spark, sf)
    io.write_weights(w, str(tmp_path / "w"), grid="a grid")
    back = io.read_weights(spark, str(tmp_path / "w"))
    assert back.exceptAll(w).isEmpty() and "a grid" in back.schema["proportion"].metadata["provenance"]
    old = w.select("river_id", "area_sqm", F.col("x_index").alias("lon_index"), F.col("y_index").alias("lat_index"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    old.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    assert io.read_weights_csv(spark, str(tmp_path / "csv")).exceptAll(w).isEmpty()


def test_cover_equals_cutting_every_cell():
    """Random stars with holes over an uneven grid with gaps: blocks inside and border cells together are what cutting shape by cell gives."""
    r = np.random.default_rng(4)
    x = np.cumsum(r.uniform(0.3, 2.0, 41))
    y = np.cumsum(r.uniform(0.3, 2.0, 31)) - 20
    x_lines, y_lines = np.stack([x[:-1], x[1:]], axis=1)[np.arange(40) % 17 != 5], np.stack([y[:-1], y[1:]], axis=1)

    def star(cx, cy, size, n):
        angle, far = np.sort(r.uniform(0, 2 * np.pi, n)), size * r.uniform(0.4, 1, n)
        return np.stack([cx + far * np.cos(angle), cy + far * np.sin(angle)], axis=1)

    rings, owner, hole = [], [], []
    for k in range(12):
        cx, cy, size = r.uniform(x[0] - 3, x[-1] + 3), r.uniform(y[0] - 3, y[-1] + 3), r.uniform(0.2, 18)
        rings += [star(cx, cy, size, r.integers(3, 60)), star(cx, cy, size / 5, 5)]
        owner += [k, k]
        hole += [False, True]
    points, ring = np.concatenate(rings), np.repeat(np.arange(len(rings)), [len(p) for p in rings])
    inside, who, cell, size = geometry.cover(points, ring, np.array(owner), np.array(hole), x_lines, y_lines)
    found = np.zeros((12, len(x_lines), len(y_lines)))
    for k, i0, i1, j0, j1 in inside:
        for i in range(i0, i1):
            for j in range(j0, j1):
                found[k, i, j] += area([(a, b) for a, b in ((x_lines[i, 0], y_lines[j, 0]), (x_lines[i, 1], y_lines[j, 0]), (x_lines[i, 1], y_lines[j, 1]), (x_lines[i, 0], y_lines[j, 1]))])
    np.add.at(found, (who, cell[:, 0], cell[:, 1]), size)
    for i, (x0, x1) in enumerate(x_lines):
        for j, (y0, y1) in enumerate(y_lines):
            cut, at = geometry.clipped(points, ring, np.tile([x0, x1, y0, y1], (len(rings), 1)))
            each = geometry.areas(cut, at, len(rings))
            assert np.allclose(found[:, i, j], each[::2] - each[1::2], rtol=1e-9, atol=1.0)
    assert len(inside) and (inside[:, 2] - inside[:, 1]).max() > 1


def test_cells_must_form_a_grid(spark, sf):
    c = weights.cells(*views.axes(spark, sf))
    some = c.where("NOT (x_index = 2 AND y_index = 3)")
    whole = weights.overlay(c, views.boxes(spark, sf))
    part = weights.overlay(some, views.boxes(spark, sf))
    assert part.count() == whole.where("NOT (x_index = 2 AND y_index = 3)").count()
    with pytest.raises(ValueError, match="do not form a grid"):
        weights.overlay(c.withColumn("x_min", F.col("x_min") - F.col("y_index") / 10), views.boxes(spark, sf))
