"""Fingerprints and components against brute force; every stage of the pigeonhole search by itself."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from cases import folder, ordered, outcome, rows

from thalweg.llm import simhash
from thalweg.llm.components import components


def fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w.decode() for w in low.encode().split()]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    """Each value's class, by comparing all pairs."""
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in values}


def by_force(found, distance=2):
    marked = [(i, fingerprint(t)) for i, t in found]
    root = groups({f for _, f in marked}, distance)
    least = {}
    for i, f in marked:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return ordered((i, f"{f:016x}", least.get(root[f])) for i, f in marked)


@pytest.mark.parametrize("leaf, short", [(simhash.LEAF, simhash.SHORT), (8, 1)])
def test_query(spark, tmp_path, monkeypatch, leaf, short):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHORT", short)
    df = simhash.op4_simhash(spark, folder(spark, tmp_path, rows()))
    assert outcome(df, "doc_id", "fingerprint", "component_id") == by_force(rows())


def test_whole_table(spark, sf):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert outcome(simhash.op4_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == by_force(found)


def test_empty_table(spark, tmp_path):
    assert simhash.op4_simhash(spark, folder(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("distance, leaf", [(2, 4096), (9, 4096), (2, 12)])
def test_links_join_what_is_near(spark, monkeypatch, distance, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    r = random.Random(distance)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:25]:
        for _ in range(3):
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, distance + 1)))
            values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()
    assert all((e.u ^ e.v & 0xFFFFFFFFFFFFFFFF).bit_count() <= 64 for e in edges)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for e in edges:
        a, b = e.u % (1 << 64), e.v % (1 << 64)
        assert (a ^ b).bit_count() <= distance
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {v: root(v) for v in values} == groups(values, distance)


def test_thresholds_cover_the_distance():
    r = random.Random(1)
    for distance, m in ((2, 3), (9, 5), (4, 1), (9, 6)):
        cost = [[0.0, *sorted(r.random() for _ in range(distance + 1))] for _ in range(m)]
        spent, chosen = simhash.allocate(cost, distance)
        assert sum(chosen) == distance - m + 1 and abs(spent - sum(c[t + 1] for c, t in zip(cost, chosen, strict=True))) < 1e-9
    assert [len(simhash.probes([1, 2, 5, 7], t)) for t in range(4)] == [simhash.n_probes(4, t) for t in range(4)] == [1, 5, 5, 11]
    parts = simhash.deal_bits(np.eye(64) * 3 + 1, 10, 5)
    assert sorted(b for p in parts for b in p) == list(range(64))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (90, 90), (101, 90), (7, 3)]
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert outcome(found, "node", "component") == ordered([(i, 1) for i in range(1, 41)] + [(i, 90) for i in (90, 100, 101)])
