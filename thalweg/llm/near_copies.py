"""Near copies by the exact Jaccard similarity of word shingles: every pair of the similarity or above links, and no other.

Links are found in two steps; both are verified by whole sets of shingle hashes (64 bits, ASCII capitals lowered; equal sets are one node).

1. SimHash fingerprints of the texts that differ in few bits (simhash.links), and equal ones. Fingerprints alone lose pairs and link unlike texts:
   at a similarity of 0.8 two of them differ in about 10 of 64 bits. They find most links at little cost, and dense groups become one component.
2. What fingerprints miss. Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of their n, in any order that is the
   same for all texts. Texts of different components that share such a key are compared. Bit sketches leave out pairs whose sets differ too much: a
   sketch's bits are parities, so that two of them never differ in more bits than their sets do in shingles. Crowded keys give a spanning
   forest of such pairs first; all pairs follow of what has stayed in different components. The order has shingles last that a sample of the
   texts finds common; the sample moves cost, never results.

A text without words has the empty set, which links to no other. A text of fewer words than a shingle is one shingle. Very long texts are taken
whole: a set is as large as its text. Texts themselves are not shuffled but for those in pairs and those that go: a bit table of fixed size
leaves out most of the others first, an exact join decides.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm import simhash
from thalweg.llm.common import bit_table, map_rows, maybe, placed, whole_row, written
from thalweg.llm.components import components

#: Texts that may share a key before they are compared in blocks, how many one block holds, and the bits of a sketch.
BUCKET, BLOCK, SKETCH = 64, 8192, 1024
#: One text of SAMPLE is counted to find common shingles: those in COMMON texts of the sample or more, up to MOST of them.
SAMPLE, COMMON, MOST = 16, 8, 100_000
#: Where a row is: its file's hash and its number there.
AT = ("file", "at")


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, in order."""
    return np.unique(simhash.shingle_hashes(text, words).view(np.int64))


def prefix(s: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share one, rare ones first. common is sorted."""
    # Looked up: the set's size counts, not that of common, which grows with the table up to MOST.
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate([s[~last], s[last]])[: len(s) - ceil(similarity * len(s) - 1e-9) + 1]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each bit: SKETCH bits, or about twice as many as a larger set has shingles. The number of bits is a power
    of two, so that a sketch folded in half is that of the half size."""
    bits = max(SKETCH, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2 == 1).view(np.int64)


def _folded(name: str, other: str):
    """A sketch at the size of the other one, which is half as long at least: sets of close sizes have no other ones."""
    half = F.size(name) / 2
    halves = F.zip_with(F.slice(name, F.lit(1), half.cast("int")), F.slice(name, (half + 1).cast("int"), half.cast("int")), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(name) > F.size(other), halves).otherwise(F.col(name))


def _same(a: str, b: str):
    return (F.col(f"{a}file") == F.col(f"{b}file")) & (F.col(f"{a}at") == F.col(f"{b}at"))


def _renamed(rows: DataFrame) -> DataFrame:
    """file and at with __ before them."""
    return rows.select(*(F.col(c).alias(f"__{c}") for c in AT))


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    some = texts.select("body").where(F.pmod(F.xxhash64("body"), F.lit(SAMPLE)) == 0).distinct()
    counted = map_rows(some, lambda: lambda x: (shingles(x, words),), "value array<long>", "body").select(F.explode("value").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.s for r in counted.orderBy(F.desc("count"), "s").limit(MOST).collect()], np.int64))  # MOST rows whatever the input


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of nodes, those of the similarity or above by their whole sets; sizes and sketches spare most others these."""
    a, b = (nodes.select(F.col("node").alias(f"__{x}"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "uv")
    differ = F.aggregate(F.zip_with(_folded("ku", "kv"), _folded("kv", "ku"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    close = pairs.join(a, F.col("u") == F.col("__u")).join(b, F.col("v") == F.col("__v")).where(_close("nu", "nv", similarity) & (differ <= (F.col("nu") + F.col("nv")) * (1 - similarity) / (1 + similarity) + 1e-9))
    close = written(close.select("u", "v"), "copies-close")
    met = close.select(F.col("u").alias("met")).union(close.select("v")).distinct()
    wanted = written(nodes.join(met, F.col("node") == F.col("met"), "left_semi").select("node", "size", F.col("least.file").alias("__file"), F.col("least.at").alias("__at")), "copies-wanted")
    some = maybe(texts.select("body", *AT), bit_table(wanted, "__file", "__at"), *AT).where("held").select("body", *AT)
    sets = map_rows(some.join(wanted, _same("", "__")).select("body", "node", "size"), lambda: lambda x: (shingles(x, words),), "value array<long>", "body")
    sets = written(sets, "copies-sets")
    a, b = (sets.select(F.col("node").alias(f"__{x}"), F.col("size").alias(f"n{x}"), F.col("value").alias(f"s{x}")) for x in "uv")
    both = close.join(a, F.col("u") == F.col("__u")).join(b, F.col("v") == F.col("__v")).select("u", "v", "nu", "nv", F.size(F.array_intersect("su", "sv")).alias("same"))
    return written(both.where(F.col("same") / (F.col("nu") + F.col("nv") - F.col("same")) >= similarity).select("u", "v"), "copies-verified")


def _close(a: str, b: str, similarity: float):
    """Sets whose sizes alone do not rule the similarity out."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def by_fingerprint(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) that connect what has equal fingerprints or near ones; to be verified."""
    leads = written(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "copies-leads")
    of = lambda x: leads.select(F.col("fp").alias(f"__{x}"), F.col("lead").alias(f"lead_{x}"))
    same = nodes.select("node", "fp").join(of("f"), F.col("fp") == F.col("__f")).where("node <> lead_f").select(F.col("lead_f").alias("u"), F.col("node").alias("v"))
    near = simhash.links(leads.select("fp"), distance).join(of("u"), F.col("u") == F.col("__u")).join(of("v"), F.col("v") == F.col("__v")).select(F.col("lead_u").alias("u"), F.col("lead_v").alias("v"))
    return same.union(near)


def parted(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Of keys (key, node, size), those that hold more than one component after those links: key, node, size, component, n."""
    reached = components(links).withColumnRenamed("node", "__node")
    placed = keys.join(reached, F.col("node") == F.col("__node"), "left").drop("__node").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "copies-placed")
    # Dealt once: the aggregation and the join ask for the same rows and columns of a table.
    keys = placed.select(F.explode("prefix").alias("key") if "prefix" in placed.columns else "key", "node", "size", "component").where("key IS NOT NULL").repartition("key")
    several = keys.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("a"), F.max("component").alias("b"), F.min("node").alias("c"), F.min("size").alias("d")).where("a < b AND d > 0 AND c IS NOT NULL")
    return written(keys.join(several, F.col("key") == F.col("__key")).select("key", "node", "size", "component", "n"), "copies-keys")


def links(texts: DataFrame, nodes: DataFrame, words: int, similarity: float, distance: int) -> DataFrame:
    """Edges (u, v) between nodes (node, size > 0, fp, prefix, sketch, least; written) that connect exactly what is similar, step by step.

    texts: body, file, at.
    """
    found = verified(by_fingerprint(nodes, distance), texts, nodes, words, similarity)
    sketches = nodes.select("node", "sketch")
    left = parted(nodes.select("node", "size", "prefix"), found)
    small = left.where(F.col("n") <= BUCKET)
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & _close("a.size", "b.size", similarity)
    pairs = small.alias("a").join(small.alias("b"), meet).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    large = left.where(F.col("n") > BUCKET)
    pairs = pairs.union(crowded(large, sketches, similarity, True)).distinct()
    found = written(found.union(verified(pairs, texts, nodes, words, similarity)), "copies-found")
    # Crowded keys again, now all pairs of what has stayed apart.
    apart = parted(large.select("key", "node", "size"), found)
    return found.union(verified(crowded(apart, sketches, similarity, False).distinct(), texts, nodes, words, similarity))


def crowded(rows: DataFrame, sketches: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Pairs (u, v) of different components that share a key of many texts and that sizes and sketches do not rule out; of a forest, only those that
    connect what the pairs before them do not.

    A key's texts are dealt into blocks of about BLOCK by hash, and each pair of blocks is compared in a task of its own.
    """
    dealt = rows.join(sketches.select(F.col("node").alias("__node"), F.col("sketch").alias("value")), F.col("node") == F.col("__node")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j"))))
    dealt = dealt.select("key", "node", "size", "component", "own", "value", other.alias("b")).select("key", "b.i", "b.j", "node", "size", "component", "own", "value")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node, size, component, own = (pdf[c].to_numpy() for c in ("node", "size", "component", "own"))
        tree = np.unique(component, return_inverse=True)[1]  # what is connected so far
        sketches = _Sketches(pdf["value"])
        one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(pdf)):
            near = (tree != tree[k]) & (node > node[k]) & (one_block | (own != own[k]))
            near &= np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k]) - 1e-9
            at = np.flatnonzero(near)
            differ = sketches.differ(k, at)
            at = at[differ <= (size[at] + size[k]) * (1 - similarity) / (1 + similarity) + 1e-9]
            if forest and len(at):
                met, first = np.unique(tree[at], return_index=True)
                at = at[first]
                tree[np.isin(tree, met)] = tree[k]
            us.append(np.full(len(at), node[k]))
            vs.append(node[at])
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")


class _Sketches:
    """Sketches of several sizes, each also folded in half."""

    def __init__(self, values: pd.Series):
        self.size = values.str.len().to_numpy(np.int64)
        self.place = np.zeros(len(values), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.whole[size] = np.stack([values.iloc[i] for i in at]).view(np.uint64)
            self.half[size] = self.whole[size][:, : size // 2] ^ self.whole[size][:, size // 2 :]

    def differ(self, k: int, at: np.ndarray) -> np.ndarray:
        """In how many bits, at the smaller size, k differs from each of those; their sizes are the same, half or double."""
        out = np.zeros(len(at), np.int64)
        size, own = int(self.size[k]), self.place[k]
        for other, mine, theirs in ((size, self.whole, self.whole), (size // 2, self.half, self.whole), (size * 2, self.whole, self.half)):
            of = self.size[at] == other
            if of.any():
                out[of] = np.bitwise_count(theirs[other][self.place[at[of]]] ^ mine[size][own]).sum(1, dtype=np.int64)
        return out


def one_of_each(docs: DataFrame, words: int, similarity: float, distance: int, text: str = "text") -> DataFrame:
    """The rows of docs, columns as they were, that stand for their components: the smallest doc_id (null last), and one row of repeated ones.

    docs: a table read from files, or what is then written as one; its rows keep their places while it is read again.
    """
    source = placed(docs, whole_row(docs, "doc"), F.col(f"`{text}`").alias("body"))
    texts = source.select(F.col("doc.doc_id").alias("doc_id"), "body", *AT)
    common = common_shingles(texts, words)

    def make():
        def row(x: str) -> tuple:
            hashes = simhash.shingle_hashes(x, words)
            s = np.unique(hashes.view(np.int64))
            return xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) - (1 << 63), len(s), simhash.signed(simhash.folded(hashes)), prefix(s, similarity, common), sketch(s)

        return row

    fields = ("size", "fp", "prefix", "sketch")
    marked = written(map_rows(texts, make, "node long, size long, fp long, prefix array<long>, sketch array<long>", "body"), "copies-marked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *AT)).alias("least")
    nodes = written(marked.groupBy("node").agg(least, *(F.first(c).alias(c) for c in fields)), "copies-nodes")
    found = components(links(texts, nodes.where("size > 0"), words, similarity, distance)).withColumnRenamed("node", "__node")
    reach = nodes.join(found, F.col("node") == F.col("__node"), "left").select("least", F.coalesce("component", "node").alias("component"))
    kept = reach.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.file").alias("__file"), F.col("least.at").alias("__at"))
    gone = written(marked.select(*AT).join(kept, _same("", "__"), "left_anti"), "copies-gone")
    rows = maybe(source.select("doc", *AT), bit_table(gone, *AT), *AT)
    return rows.where("NOT held").select("doc.*").union(rows.where("held").join(_renamed(gone), _same("", "__"), "left_anti").select("doc.*"))
