"""SimHash near-duplicates under a generalised pigeonhole search.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in at most `distance` bits link.
The search works on distinct fingerprints. The 64 bits are dealt into partitions, correlated bits together, by the correlations counted over
all fingerprints. If two fingerprints differ in at most d bits, then for thresholds t_1..t_m with sum d - m + 1 some partition differs in at
most t_i bits (a threshold of -1 leaves a partition out); dynamic programming takes the thresholds with the least estimated cost, from
histograms of all fingerprints. Both sides probe the
partition's values within half its threshold, and candidates are verified by popcount.

What shares a probe value comes out as a spanning forest, never as pairs. A value that more than LEAF fingerprints share is dealt anew by the bits
that are still free: two of them within the distance agree in one of distance + 1 pieces of these. That repeats until values are small, so a dense
group costs about its size, no task holds more than LEAF of a value, and no link is lost.

A null or empty text, or one of white space, has fingerprint zero. Equal fingerprints are one node, so exact copies and repeated rows cost
nothing. component_id is the smallest doc_id reachable; null ids are never the smallest unless a component has no other. An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import documents, map_rows, written
from thalweg.llm.components import components

BITS, SEED = 64, 42
WORDS, DISTANCE = 3, 2
#: Numbers of partitions that the plan chooses from.
PARTITIONS = (6, 5, 4, 3, 2, 1)
#: Fingerprints that share a probe value and are compared in one place at most, runs that are compared all at once, and the cost of shuffling a
#: probe in comparisons.
LEAF, SHORT, ROW_COST = 4096, 32, 30
#: Places that a component's least id goes to, and all bits.
SALTS, ALL = 16, (1 << BITS) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingle hashes turned into bits at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hashes of a whole text's shingles in order, repeats included, ASCII capitals lowered; none of a text without words."""
    body = b" ".join(text.encode().translate(_LOWER).split())  # bytes split at the six white-space characters, and no other
    if not body:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(body)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, ends[min(words, len(ends)) - 1 :], strict=False)), np.uint64)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits that over half of them have set."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a whole text; zero without words."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """docs without its text, with fingerprint as a signed 64-bit number."""

    def make():
        def row(x: str) -> tuple:
            return (signed(fingerprint(x, words)),)

        return row

    return map_rows(docs, make, "fp long", text)


def joint_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set, for all 64 x 64 pairs: a matrix from each partition, summed by place."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                fp = batch.column(0).slice(at, CHUNK).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["place", "n"])

    sums = fps.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # 4096 rows whatever the input
    out = np.zeros(BITS * BITS)
    for place, n in sums:
        out[place] = n
    return out.reshape(BITS, BITS)


def deal_bits(joint: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits dealt to partitions of about equal width, correlated bits together: what two edited copies differ in then falls in few partitions."""
    p = np.diag(joint) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.abs(np.divide(joint / n - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(partitions):
        width = -(-len(left) // (partitions - k))
        part = [min(left, key=lambda b: (-strength[b, sorted(left)].sum(), b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(min(left, key=lambda b: (-strength[b, part].sum(), b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def value(fp: Column, bits: list[int]) -> Column:
    """A partition's bits; the others are masked out."""
    return fp.bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))


def probes(bits: list[int], threshold: int) -> list[int]:
    """Masks of half the threshold's bits: two values within the threshold share a value that lies within its half, rounded up, of both."""
    return [signed(sum(1 << b for b in c)) for k in range((threshold + 1) // 2 + 1) for c in combinations(bits, k)]


def n_probes(width: int, threshold: int) -> int:
    """How many masks probes() gives for a partition of so many bits."""
    return sum(comb(width, k) for k in range((threshold + 1) // 2 + 1))


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) with sum distance - m + 1 of the least cost; cost[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for each in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, distance + 1):
                if used + t not in step or spent + each[t + 1] < step[used + t][0]:
                    step[used + t] = (spent + each[t + 1], [*chosen, t])
        best = step
    return best[distance - len(cost) + 1]


def meetings(fps: DataFrame, parts: list[list[int]]) -> dict[tuple[int, ...], float]:
    """For each partition, pairs of fingerprints that share its value, each value at most at LEAF a member: beyond it, members are dealt
    anew. One job counts all partitions' values."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), value(F.col("fp"), bits).alias("v")) for k, bits in enumerate(parts)))).alias("x")
    size = F.col("count")
    pairs = fps.select(values).groupBy("x.part", "x.v").count().groupBy("part").agg(F.sum(F.least(size - 1, F.lit(LEAF)) * size / 2).alias("met"))
    return {tuple(parts[k]): float(met) for k, met in pairs.collect()}  # a row a partition


def plan(fps: DataFrame, distance: int, partitions: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of the least estimated cost: rows probed plus candidates met, from histograms over all fingerprints."""
    n = max(1, fps.count())
    joint = joint_counts(fps)
    # More partitions than distance + 1 leave thresholds below zero in all plans: some partitions would go unused.
    dealt = {m: deal_bits(joint, n, m) for m in partitions if m <= distance + 1}
    known = meetings(fps, [bits for parts in dealt.values() for bits in parts])
    best = None
    for parts in dealt.values():
        cost = []
        for bits in parts:
            met = known.get(tuple(bits), 0.0)
            cost.append([0.0] + [masks * ROW_COST * n + masks**2 * met for masks in (n_probes(len(bits), t) for t in range(distance + 1))])
        spent, chosen = allocate(cost, distance)
        if best is None or spent < best[0]:
            best = (spent, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def probed(fps: DataFrame, part: int, bits: list[int], threshold: int) -> DataFrame:
    """(part, v, fp): the values that a fingerprint probes in a partition."""
    base, masks = value(F.col("fp"), bits), [F.lit(m).cast("long") for m in probes(bits, threshold)]
    return fps.select(F.lit(part).alias("part"), F.explode(F.transform(F.array(*masks), lambda m: base.bitwiseXOR(m))).alias("v"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE, partitions: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what differs in at most `distance` bits, step by step."""
    plans = plan(fps, distance, partitions)
    rows = reduce(DataFrame.union, [probed(fps, k, bits, t) for k, (bits, t) in enumerate(plans)])
    free = F.element_at(F.array(*(F.lit(signed(~sum(1 << b for b in bits) & ALL)).cast("long") for bits, _ in plans)), F.col("part") + 1)
    rows = rows.select(F.xxhash64("part", "v").alias("key"), free.alias("free"), "fp")  # keys that meet by accident cost comparisons, no more
    found = None
    while True:
        sizes = rows.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = written(rows.join(sizes, F.col("key") == F.col("__key")).select("key", "free", "fp", "n"), "simhash-probes")
        crowded = (F.col("n") > LEAF) & (F.col("free") != 0)
        edges = met.where(~crowded).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_forests(distance), "u long, v long")
        found = edges if found is None else found.union(edges)
        rows = met.where(crowded).select("key", "free", "fp")
        if rows.isEmpty():
            return found.distinct()
        rows = rows.mapInArrow(_dealt_again(distance), "key long, free long, fp long")


def _dealt_again(distance: int):
    """Rows (key, free, fp) under distance + 1 keys each: two fingerprints of a key within the distance agree in one of so many pieces of the bits that
    are still free."""

    def run(batches):
        for batch in batches:
            key, free, fp = (batch.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in range(3))
            for mask in np.unique(free).tolist():
                at = np.flatnonzero(free == np.uint64(mask))
                bits = [b for b in range(BITS) if mask >> b & 1]
                for piece in range(distance + 1):
                    own = np.uint64(sum(1 << b for b in bits[piece :: distance + 1]))
                    mixed = (key[at] ^ np.uint64(piece + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (fp[at] & own) * np.uint64(0xC2B2AE3D27D4EB4F)
                    left = np.full(len(at), np.uint64(mask) & ~own)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mixed, left, fp[at])], ["key", "free", "fp"])

    return run


def _forests(distance: int):
    """Rows (key, fp) in order of key -> edges (u, v): spanning forests of what shares a key and is near."""

    def run(batches):
        for key, fp in _whole_runs(batches):
            u, v = forests(key, fp.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def _whole_runs(batches):
    """Two columns of batches in order of the first, cut so that equal values stay together."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, fp = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, fp)))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield key[:cut], fp[:cut]
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield key, fp


def forests(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of spanning forests within runs of equal keys: at most one fewer than a run has members."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        for out, x in zip((us, vs), spanning(fp[a : a + n], distance), strict=True):
            out.append(x.view(np.uint64))
    # Short runs all at once, by what lies 1, 2, ... places on; then a root for each place.
    short = np.repeat(size <= SHORT, size)
    pairs = []
    for k in range(1, int(size[size <= SHORT].max(initial=1))):
        near = (key[:-k] == key[k:]) & short[k:] & (np.bitwise_count(fp[:-k] ^ fp[k:]) <= distance)
        pairs += [(i, i + k) for i in np.flatnonzero(near).tolist()]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    tree = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            tree.append((i, j))
    at = np.array(tree, np.int64).reshape(-1, 2)
    return np.concatenate([*us, fp[at[:, 0]]]), np.concatenate([*vs, fp[at[:, 1]]])


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning trees of the graph in which fingerprints within the distance are linked: edges (u, v).

    Breadth first: what has been reached is only compared with what has not. One dense group costs about its size, not its square.
    """
    left = np.unique(fp).view(np.uint64)
    us, vs = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            parent = np.zeros(len(left), np.uint64)
            for x in front:
                hit = (np.bitwise_count(left ^ x) <= distance) & ~reached
                parent[hit] = x
                reached |= hit
                if reached.all():
                    break
            us.append(parent[reached])
            vs.append(left[reached])
            front, left = left[reached], left[~reached]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]).view(np.int64), np.concatenate([none, *vs]).view(np.int64)


def clusters(marked: DataFrame, distance: int = DISTANCE, key: str = "doc_id") -> DataFrame:
    """Rows with fp and key -> with component_id (the smallest key reachable). Read twice: give it a written table."""
    nodes = written(marked.groupBy("fp").agg(F.min(key).alias("__least")), "simhash-nodes")
    found = components(links(nodes.select("fp"), distance))
    reach = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "__least", F.coalesce("component", "fp").alias("component"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    # A component may hold most fingerprints: its least key goes to each of SALTS places.
    least = reach.groupBy("component").agg(F.min("__least").alias("component_id"), F.count(F.lit(1)).alias("n"), F.min("salt").alias("own"))
    places = F.when(F.col("n") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array("own"))
    ids = reach.join(least.select("component", "component_id", F.explode(places).alias("salt")), ["component", "salt"]).select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(ids, F.col("fp") == F.col("__fp")).drop("__fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clusters(written(fingerprints(documents(spark, sf_dir, "doc_id", "text")), "simhash-fingerprints"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
