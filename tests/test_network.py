import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import network, validate

EDGES = [(1, 5), (2, 5), (3, 6), (4, 6), (5, 7), (6, 7), (7, 9), (8, 9), (9, -1)]


@pytest.fixture(scope="module")
def net(spark):
    return spark.createDataFrame([(r, d, 3600.0, 0.2) for r, d in EDGES], "river_id long, downstream_river_id long, k double, x double")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_orders_of_the_example(net):
    assert dict(pairs(network.strahler(net))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 1, 9: 3}


def test_roots_and_distances(net):
    assert pairs(network.rooted(net)) == {(1, 9, 3), (2, 9, 3), (3, 9, 3), (4, 9, 3), (5, 9, 2), (6, 9, 2), (7, 9, 1), (8, 9, 1), (9, 9, 0)}


def test_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1 if i < 300 else -1, 1.0, 0.1) for i in range(1, 301)], "river_id long, downstream_river_id long, k double, x double")
    assert network.rooted(chain).where("watershed_id <> 300 OR dist <> 300 - river_id").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        network.rooted(spark.createDataFrame([(1, 2), (2, 1)], "river_id long, downstream_river_id long"))


def test_subset_makes_the_target_an_outlet(net, spark):
    weights = spark.createDataFrame([(r, 1) for r, _ in EDGES], "river_id long, x_index int")
    part, few = network.subset(net, 7, weights)
    assert {r["river_id"]: r["downstream_river_id"] for r in part.collect()} == {1: 5, 2: 5, 3: 6, 4: 6, 5: 7, 6: 7, 7: -1}
    assert {r["river_id"] for r in few.collect()} == {1, 2, 3, 4, 5, 6, 7}
    with pytest.raises(ValueError, match="not in the network"):
        network.subset(net, 99)


def test_adjacency_rejects_bad_networks(spark):
    schema = "position long, river_id long, downstream_river_id long"
    with pytest.raises(ValueError, match="sorted"):
        network.adjacency(spark.createDataFrame([(0, 10, 20), (1, 20, -1), (2, 30, 10)], schema))
    with pytest.raises(ValueError, match="no river"):
        network.adjacency(spark.createDataFrame([(0, 10, -1), (1, 20, 999)], schema))


def test_river_zero_is_a_river(spark):
    net = spark.createDataFrame([(5, 0), (0, -1)], "river_id long, downstream_river_id long")
    assert pairs(network.rooted(net)) == {(5, 0, 1), (0, 0, 0)}
    assert pairs(network.in_degree(net)) == {(5, 0), (0, 1)}


def test_validation_names_every_rule(spark, net):
    assert validate.params(net).isEmpty()
    bad = spark.createDataFrame([(1, None, 1.0, 0.1), (None, -1, 1.0, 0.1), (3, -2, float("nan"), None)], "river_id long, downstream_river_id long, k double, x double")
    rules = {r["rule"] for r in validate.params(bad).collect()}
    assert rules == {"null id", "null downstream id", "downstream id below -1", "k not positive", "x outside 0 to 0.5"}
    with pytest.raises(ValueError, match="lacks"):
        validate.params(bad.drop("k"))
    with pytest.raises(ValueError, match="k not positive"):
        validate.require(validate.params(bad), "parameters")


def plain_orders(flows):
    """Orders from the headwaters down, one river at a time."""
    above, order = {}, {}
    for r, d in flows.items():
        above.setdefault(d, []).append(r)

    def of(r):
        found = sorted((order[u] for u in above.get(r, ())), reverse=True)
        return 1 if not found else found[0] + (found[1:2] == found[:1])

    waiting = {r: len(above.get(r, ())) for r in flows}
    ready = [r for r, n in waiting.items() if not n]
    while ready:
        r = ready.pop()
        order[r] = of(r)
        d = flows[r]
        if d in waiting:
            waiting[d] -= 1
            if not waiting[d]:
                ready.append(d)
    return order


def test_orders_by_contraction(spark):
    """Random forests, a chain with side branches, a confluence of very many, and a chain of 5000: rounds grow with the logarithm of the size."""
    r = random.Random(5)
    bushy = {k: (-1 if k < 3 or r.random() < 0.02 else r.randrange(max(0, k - 9), k)) for k in range(400)}
    comb = {**{k: k - 1 for k in range(1000, 1100)}, **{k + 1000: k for k in range(1000, 1100, 7)}, **{k + 2000: k + 1000 for k in range(1000, 1100, 14)}, **{k + 3000: k + 1000 for k in range(1000, 1100, 14)}, 1000: -1}
    star = {5000: -1, **{k: 5000 for k in range(5001, 5200)}}
    chain = {k: k - 1 if k > 10000 else -1 for k in range(10000, 15000)}
    flows = bushy | comb | star | chain
    net = spark.createDataFrame(list(flows.items()), "river_id long, downstream_river_id long")
    assert {x.river_id: x.strahler for x in network.strahler(net).collect()} == plain_orders(flows)
    with pytest.raises(ValueError, match="cycle"):
        network.strahler(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "river_id long, downstream_river_id long"))
    assert network.strahler(net.where("false")).count() == 0


def test_order_functions_compose(spark):
    pairs = [(a, p) for a in range(5) for p in range(a + 2)]
    rows = [((a, p), (c, r), x) for a, p in pairs for c, r in pairs for x in range(1, 9)]
    df = spark.createDataFrame(rows, "g struct<a:int,p:int>, f struct<a:int,p:int>, x int")
    once = network.order_from(network.order_after(F.col("g"), F.col("f")), F.col("x"))
    assert df.where(once != network.order_from(F.col("g"), network.order_from(F.col("f"), F.col("x")))).isEmpty()
