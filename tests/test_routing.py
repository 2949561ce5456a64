import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import kernels
from thalweg.operators import routing
from thalweg.sources import views

T, HOUR = 24, 3600


@pytest.fixture(scope="module")
def net(spark, sf):
    return views.net(spark, sf)


@pytest.fixture(scope="module")
def lateral(spark, sf):
    return views.qlateral(spark, sf).where(F.col("t") < T)


def matrix(df, value="discharge"):
    rows = sorted(df.select("river_id", value).collect())
    return np.array([r[1] for r in rows])


def dense(net_rows, kind, v, substeps, q0):
    """All rivers at each substep, by a linear solve: the other order of the two loops."""
    ids = [r["river_id"] for r in net_rows]
    n, at = len(ids), {r: i for i, r in enumerate(ids)}
    a = np.zeros((n, n))
    for r in net_rows:
        if r["downstream_river_id"] >= 0:
            a[at[r["downstream_river_id"]], at[r["river_id"]]] = 1
    ratio = np.array([HOUR / substeps / r["k"] for r in net_rows])
    x = np.array([r["x"] for r in net_rows])
    below = ratio + 2 * (1 - x)
    c1, c2, c3 = (ratio - 2 * x) / below, (ratio + 2 * x) / below, (2 * (1 - x) - ratio) / below
    q, out = q0.copy(), []
    for t in range(T):
        total = np.zeros(n)
        for _ in range(substeps):
            rhs = c2 * (a @ q) + c3 * q
            if kind == "rapid":
                rhs = rhs + (c1 + c2) / HOUR * v[:, t]
            q = np.linalg.solve(np.eye(n) - c1[:, None] * a, rhs)
            total += q
        out.append(np.maximum(total / substeps, 0))
    return np.array(out).T, q


@pytest.mark.parametrize("strategy, task_numbers", [("grouped", 1), ("levels", 2 * 3 * T), ("auto", 5 * 3 * T), ("auto", 10**6)])
@pytest.mark.parametrize("kind", ["rapid", "channel"])
def test_against_a_dense_solve(spark, sf, net, lateral, kind, strategy, task_numbers):
    rows = sorted(net.collect())
    v = np.array([r[1] for r in sorted(kernels.packed(lateral, "t", "v", "v").collect())])
    q0 = np.array([10.0 + r["river_id"] % 7 for r in rows])
    routed = routing.route(kind, net, lateral if kind == "rapid" else None, T, HOUR, 3, views.state(spark, sf), strategy=strategy, task_numbers=task_numbers).cache()
    want, state = dense(rows, kind, v, 3, q0)
    assert np.allclose(matrix(routed), want, atol=1e-9)
    assert np.allclose(matrix(routed, "state"), state, atol=1e-9)


def test_unit_strategies_agree_and_headwaters_carry_their_inflow(net, lateral):
    grouped = routing.route("unit", net, lateral, T, HOUR, 2, strategy="grouped")
    levels = routing.route("unit", net, lateral, T, HOUR, 2, strategy="levels", task_numbers=3 * 2 * T)
    assert np.allclose(matrix(grouped), matrix(levels), atol=1e-9)
    v = np.array([r[1] for r in sorted(kernels.packed(lateral, "t", "v", "v").collect())])
    fed = {r["downstream_river_id"] for r in net.collect()}
    heads = [i for i, r in enumerate(sorted(net.collect())) if r["river_id"] not in fed]
    assert np.allclose(matrix(grouped)[heads], v[heads])


def test_nothing_in_nothing_out(net, lateral):
    assert (matrix(routing.route("rapid", net, lateral.withColumn("v", F.lit(0.0)), T, HOUR)) == 0).all()


def test_split_equals_whole(net, lateral):
    whole = matrix(routing.route("rapid", net, lateral, T, HOUR))
    first = routing.route("rapid", net, lateral.where("t < 10"), 10, HOUR)
    rest = routing.route("rapid", net, lateral.where("t >= 10").withColumn("t", F.col("t") - 10), T - 10, HOUR, state=first.select("river_id", F.col("state").alias("q")))
    assert np.allclose(np.hstack([matrix(first), matrix(rest)]), whole, atol=1e-9)


def test_an_initial_state_decays(spark, sf, net):
    q = matrix(routing.route("channel", net, None, 200, HOUR, 1, views.state(spark, sf)))
    assert (q >= 0).all() and (q[:, -1] < 1e-3).all() and q[:, 0].max() > 1


def test_a_deep_chain_in_pieces(spark):
    """5000 segments in a row, cut to pieces of at most 700: as when solved whole."""
    n = 5000
    net = spark.createDataFrame([(i, i + 1 if i < n else -1, 3600.0, 0.2) for i in range(1, n + 1)], "river_id long, downstream_river_id long, k double, x double")
    state = net.select("river_id", (F.col("river_id") % 13).cast("double").alias("q"))
    whole = routing.route("channel", net, None, 4, HOUR, 1, state, strategy="grouped")
    pieces = routing.route("channel", net, None, 4, HOUR, 1, state, task_numbers=4 * 700)
    assert np.allclose(matrix(whole), matrix(pieces), atol=1e-9) and np.allclose(matrix(whole, "state"), matrix(pieces, "state"), atol=1e-9)


def test_rivers_and_series_must_match(net, lateral):
    with pytest.raises(Exception, match="not in the network"):
        routing.route("rapid", net.where("river_id <> 7"), lateral, T, HOUR).collect()
    with pytest.raises(Exception, match="without lateral inflow"):
        routing.route("rapid", net, lateral.where("river_id <> 7"), T, HOUR).collect()


def test_time_options():
    routing.Steps(900, 3600, 7200, 14400)
    for bad in [(7200, 3600, 3600, 3600), (900, 3600, 3600, 4000), (1000, 3600, 3600, 7200), (900, 3600, 1800, 7200)]:
        with pytest.raises(ValueError):
            routing.Steps(*bad)


@pytest.mark.parametrize("kind, chunk, size", [("rapid", 5, 2000), ("rapid", 24, 2000), ("unit", 7, 2000), ("unit", 5, 1), ("rapid", 100, 1)])
def test_chunks_of_time_equal_the_whole(spark, sf, net, lateral, monkeypatch, kind, chunk, size):
    """Days side by side, with a state, for two members at once, chunks that do not divide the horizon, and both ways of carrying flows on."""
    monkeypatch.setattr(routing, "MATRIX", size)
    both = lateral.withColumn("m", F.lit("a")).union(lateral.withColumn("v", F.col("v") * F.lit(2) + F.col("river_id") % 3).withColumn("m", F.lit("b")))
    given = (kind, net, both, T, HOUR, 3, views.state(spark, sf), "m")
    whole = {(r["river_id"], r["m"]): r for r in routing.route(*given, strategy="grouped").collect()}
    found = routing.route(*given, strategy="chunks", chunk=chunk).collect()
    assert len(found) == len(whole)
    for r in found:
        want = whole[r["river_id"], r["m"]]
        assert np.allclose(r["discharge"], want["discharge"], rtol=1e-9, atol=1e-9) and np.isclose(r["state"], want["state"], rtol=1e-9) and r["watershed_id"] == want["watershed_id"]


def test_chunks_check_their_series(spark, net, lateral):
    for bad, said in ((lateral.where("NOT (river_id = 3 AND t = 7)"), "for every river"), (lateral.where("river_id <> 3"), "for every river"), (lateral.withColumn("river_id", F.when(F.col("river_id") == 3, 999).otherwise(F.col("river_id")).cast("long")), "not in the network|for every river")):
        with pytest.raises(Exception, match=said):
            routing.route("rapid", net, bad, T, HOUR, strategy="chunks", chunk=6).collect()
    chunks = routing.route_chunks("rapid", net, lateral, 1, HOUR, T, 6)
    assert chunks.groupBy("first").count().count() == 4 and chunks.where("state IS NOT NULL").count() == net.count()


def test_small_pieces_share_tasks(spark):
    """A comb of 200 rivers, of which no piece may have over 8: its many single rivers come to few bins, and a piece is never cut."""
    rows = [(1, -1, 0)] + [(r, r - 1 if r <= 20 else r % 20 + 1, 0) for r in range(2, 201)]
    dist = {1: 0}
    for r, down, _ in rows[1:]:
        dist[r] = dist[down] + 1
    net = spark.createDataFrame([(r, down, dist[r]) for r, down, _ in rows], "river_id long, downstream_river_id long, dist int")
    found = {r["river_id"]: (r["band"], r["bin"]) for r in routing.dealt(net, 64).collect()}
    pieces = {r["river_id"]: r["piece"] for r in routing.cut_to_pieces(net, 64).collect()}
    assert sorted(found) == list(range(1, 201)) and len(set(found.values())) < len(set(pieces.values()))
    assert len({(p, *found[r]) for r, p in pieces.items()}) == len(set(pieces.values()))


@pytest.mark.parametrize("strategy, task_numbers", [("levels", 3 * T), ("auto", 5 * T), ("auto", 10**6)])
def test_arrays_are_routed_as_rows_are(net, lateral, strategy, task_numbers):
    """Two members, as arrays and as rows, with the tables kept or not."""
    rows = lateral.withColumn("member", F.lit("a")).union(lateral.withColumn("v", F.col("v") * 2).withColumn("member", F.lit("b"))).select("river_id", "t", "v", "member")
    arrays = kernels.packed(rows, "t", "v", "v", "river_id", "member")
    out = [
        sorted(routing.route("rapid", net, x, T, HOUR, member="member", strategy=strategy, task_numbers=task_numbers, kept=kept).select("member", "river_id", "discharge", "state", "watershed_id").collect())
        for x, kept in ((rows, False), (rows, True), (arrays, False))
    ]
    assert len(out[0]) == 20 and out[0] == out[1] == out[2]
    single = routing.route("rapid", net, lateral, T, HOUR, strategy="grouped")
    assert np.allclose(np.array([r["discharge"] for r in out[0][:10]]), matrix(single), atol=1e-9)
