"""Candidates for repeated windows: what two documents, or two places, may share.

A text is a sequence of units (bytes, words), a window is `width` units. Each window has an anchor, the run of `gram` units in it whose order
value is least (the last of equals), so that equal windows have equal anchors at equal offsets, wherever they stand. Consecutive windows with
one anchor form a stretch; its content goes on to `reach` units from the last window's start, so that longer strings can be told too.

1. Equal texts are one text, by their digests; only one row of each goes on.
2. Anchors are counted over all texts. Stretches whose anchor occurs in one text only (and once in it, where that matters) go no further.
3. What is left is reduced to distinct stretches, and those with one anchor meet in one shard, where an operator's index judges their windows.
4. An anchor with over CROWD distinct stretches would not fit a shard. Its stretches are cut by where windows stand around the anchor, and what all
   windows of a cut have in common becomes their anchor. That repeats with finer cuts. The last of these holds equal windows only, which may go on
   in different ways up to `reach`. Where over CROWD of these ways are left, the window is repeated as such, and strings up to `reach` are equal
   where their names are: they are counted by name (Units.crowded) and meet in no shard. All else is judged by the index of a shard of bounded size.

Texts are shuffled only where they have candidates; tables of fixed size leave out most of the others (common.bit_table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import SLICE, bit_table, maybe, placed, small_batches, spent, text_key, written

#: Distinct stretches of one anchor that a shard takes, and units of stretches in a shard.
CROWD, SHARD_UNITS = 2048, 1_000_000
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def scramble(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for the longest text so far."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` units: differences of prefix sums of a polynomial modulo 2**64, mixed."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(_BASE, len(codes)), out=sums[1:])
    return scramble((sums[gram:] - sums[:-gram]) * _power(_INVERSE, len(codes) - gram + 1))


def stretches(order: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the order values of all runs (their upper 32 bits count): (place of the anchor, first window, last window) of each stretch."""
    span = width - gram + 1
    n = len(order) - span + 1
    # The place, counted backwards, in the lower half: the last of equals is the least.
    least, have = order & np.uint64(0xFFFFFFFF00000000) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(order), -1, dtype=np.uint64), 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[span - have : span - have + n])
    place = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[start], start, np.concatenate([start[1:] - 1, [n - 1]])


class Units:
    """How an operator sees a text: codes (a number a unit), the content of a range of units, and the order of runs."""

    width: int
    gram: int
    unit_bytes: int
    #: Bytes of the shortest text that has a window.
    least_bytes: int
    #: Units from the start of a stretch's last window that its content goes on to.
    reach: int
    #: Windows in a cut of crowded stretches, the last one 1.
    range_sizes: tuple[int, ...]

    def read(self, text: str):
        raise NotImplementedError

    def codes(self, units) -> np.ndarray:
        """64 random bits a unit."""
        raise NotImplementedError

    def content(self, units, start: int, end: int) -> bytes:
        raise NotImplementedError

    def split(self, content: bytes):
        """The units of a content."""
        raise NotImplementedError

    def crowded(self, n: Column, content: Column) -> Column:
        """The marks of a stretch of one window that many others begin with: n is how often it occurs, content goes on up to `reach`."""
        raise NotImplementedError

    def order(self, codes: np.ndarray, grams: np.ndarray, units) -> np.ndarray:
        return grams

    def found(self, text: str):
        """units, and of each stretch: anchor hash, the anchor's place, first window, last window."""
        units = self.read(text)
        codes = self.codes(units)
        none = np.zeros(0, np.int64)
        if len(codes) < self.width:
            return units, none, none, none, none
        grams = gram_hashes(codes, self.gram)
        place, first, last = stretches(self.order(codes, grams, units), self.width, self.gram)
        return units, grams[place].view(np.int64), place, first, last


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def _chunks(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)


def anchors(texts: DataFrame, units: Units, within: bool) -> DataFrame:
    """(id, anchor): the distinct anchors of each text, and if `within` once more what a text has several times. texts: id, text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, found = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own, n = np.unique(units.found(text)[1], return_counts=True)
                    own = np.concatenate([own, own[n > 1]]) if within else own
                    ids.append(np.full(len(own), key, np.int64))
                    found.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, found)], ["id", "anchor"])

    return small_batches(texts.select("id", "text")).mapInArrow(run, "id long, anchor long")


CONTENTS = "key binary, first long, rows long, stretch binary, anchor long, offset int, windows int, content binary, starts array<int>"


def contents(texts: DataFrame, units: Units) -> DataFrame:
    """CONTENTS: the stretches of each text whose anchors are in `shared`, equal ones of a text together.

    texts: key, first, rows, text, shared (array of anchors). offset is the anchor's place in the content, starts are the first windows of the
    occurrences, windows how many a stretch has, stretch its name.
    """
    types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    schema = pa.schema(list(zip((f.split()[0] for f in CONTENTS.split(", ")), types, strict=True)))

    def rows(batches):
        for key, first_id, n, text, shared in _texts(batches):
            seq, ids, place, first, last = units.found(text)
            own: dict[tuple, list] = {}
            for i in np.flatnonzero(np.isin(ids, np.array(shared, np.int64))):
                a, b = int(first[i]), int(last[i])
                what = (int(place[i]) - a, b - a + 1, units.content(seq, a, b + units.reach))
                own.setdefault(what, [int(ids[i]), []])[1].append(a)
            for (offset, windows, content), (anchor, starts) in own.items():
                yield key, first_id, n, _name(offset, windows, content), anchor, offset, windows, content, starts

    return small_batches(texts.select("key", "first", "rows", "text", "shared")).mapInArrow(lambda b: _chunks(rows(b), schema, 2048), CONTENTS)


def _name(offset: int, windows: int, content: bytes) -> bytes:
    return md5(b"%d %d " % (offset, windows) + content).digest()


def candidates(docs: DataFrame, texts: DataFrame, units: Units, within: bool) -> DataFrame:
    """contents() of the anchors that occur in two texts, or twice in one if `within`. docs: text, key, file, at; texts: key, file, at, first, rows."""
    at = lambda a, b: (F.col(a) == F.col("__file")) & (F.col(b) == F.col("__at"))
    named = docs.select("key", "text", "file", "at").where(F.octet_length("text") >= units.least_bytes)
    # Of equal texts only one has its anchors found.
    more = docs.select("key", "file", "at").join(texts.where("rows > 1").select(F.col("key").alias("__key"), F.col("file").alias("__file"), F.col("at").alias("__at")), F.col("key") == F.col("__key")).where(~at("file", "at")).select(F.col("file").alias("__file"), F.col("at").alias("__at"))
    more = written(more, "repeats-equal")
    flagged = maybe(named, bit_table(more, "__file", "__at"), "file", "at")
    one = flagged.where("NOT held").select("key", "text").union(flagged.where("held").join(more, at("file", "at"), "left_anti").select("key", "text"))
    # Written, then dealt once, for the aggregation and for the join: both ask for the same rows and columns.
    each = written(anchors(one.select(F.xxhash64("key").alias("id"), "text"), units, within), "repeats-anchors")
    found = each.where("anchor IS NOT NULL").repartition("anchor")
    counted = found.groupBy(F.col("anchor").alias("__anchor")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = counted.where("a < b OR n > 1" if within else "a < b").select("__anchor")
    own = found.join(shared.hint("shuffle_hash"), F.col("anchor") == F.col("__anchor")).groupBy(F.col("id").alias("__id")).agg(F.collect_set("anchor").alias("shared"))
    own = written(texts.join(own, F.xxhash64("key") == F.col("__id")).select(F.col("file").alias("__file"), F.col("at").alias("__at"), "first", "rows", "shared"), "repeats-shared")
    spent(each)
    some = maybe(named, bit_table(own, "__file", "__at"), "file", "at").where("held")
    return written(contents(some.join(own, at("file", "at")), units), "repeats-candidates")


PIECE = ("stretch", "anchor", "offset", "windows", "content")


def judged(found: DataFrame, units: Units, judge: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """(stretch, marks): what the judge says of each distinct stretch.

    found: PIECE, first, n (its smallest doc_id and how often it occurs). judge gets distinct stretches of a shard, those of an anchor together, and
    gives marks of fixed size for the windows of each.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "stretch"], ignore_index=True)
        return pd.DataFrame({"stretch": pdf["stretch"], "marks": judge(pdf)})

    def distinct(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy(*PIECE).agg(F.min("first").alias("first"), F.sum("n").alias("n")), "repeats-stretches")

    pieces, leaves, cuts, named = distinct(found), [], [], None
    for size in (*units.range_sizes, None):
        crowds = written(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select(F.col("anchor").alias("__a")), "repeats-crowds")
        if crowds.isEmpty():
            leaves.append(pieces)
            break
        leaves.append(pieces.join(crowds, F.col("anchor") == F.col("__a"), "left_anti"))
        if size is None:
            named = pieces.join(crowds, F.col("anchor") == F.col("__a"), "left_semi").select("stretch", units.crowded(F.col("n"), F.col("content")).alias("marks"))
            break
        cut = written(small_batches(pieces.join(crowds, F.col("anchor") == F.col("__a")).select(*PIECE, "first", "n")).mapInArrow(_cutter(units, size), CUT), "repeats-cuts")
        cuts.append(cut.select("parent", "low", "stretch"))
        pieces = distinct(cut)
    out = None
    for level in range(len(leaves) - 1, -1, -1):
        rows = leaves[level]
        shards = max(1, -(-int(rows.agg(F.sum(F.length("content"))).first()[0] or 0) // (SHARD_UNITS * units.unit_bytes)))
        here = rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(run, "stretch binary, marks binary")
        if named is not None:
            here, named = here.union(named), None
        if out is not None:
            # A stretch's marks are those of its cuts in order; it has at most as many cuts as windows.
            below = cuts[level].join(out.select(F.col("stretch").alias("__s"), "marks"), F.col("stretch") == F.col("__s"))
            joined = below.groupBy(F.col("parent").alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("low", "marks"))).alias("cuts"))
            here = here.union(joined.select("stretch", F.aggregate("cuts", F.expr("CAST('' AS BINARY)"), lambda a, x: F.concat(a, x["marks"]))))
        out = here
    return out


CUT = "parent binary, low int, stretch binary, anchor long, offset int, windows int, content binary, first long, n long"


def _cutter(units: Units, size: int):
    """PIECE, first, n -> CUT: windows dealt by how far before the anchor they start, `size` to a cut; its anchor is what its windows share."""
    schema = pa.schema([("parent", pa.binary()), ("low", pa.int32()), ("stretch", pa.binary()), ("anchor", pa.int64()), ("offset", pa.int32()), ("windows", pa.int32()), ("content", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])

    def rows(batches):
        for parent, anchor, offset, windows, content, first, n in _texts(batches):
            seq = units.split(content)
            for place in range((offset - windows + 1) // size, offset // size + 1):
                nearest, farthest = place * size, place * size + size - 1
                low, high = max(0, offset - farthest), min(windows - 1, offset - nearest)
                if low > high:
                    continue
                common = units.content(seq, max(0, offset - nearest), offset - farthest + units.width)
                own = units.content(seq, low, high + units.reach)
                key = xxhash.xxh64_intdigest(b"%d %d %d " % (anchor, size, place) + common) - (1 << 63)
                yield parent, low, md5(b"%d " % key + _name(offset - low, high - low + 1, own)).digest(), key, offset - low, high - low + 1, own, first, n

    return lambda batches: _chunks(rows(batches), schema, 2048)


def search(docs: DataFrame, units: Units, within: bool, judge: Callable[[pd.DataFrame], list[bytes]]) -> tuple[DataFrame, DataFrame]:
    """(docs with doc_id, text, key; verdicts): for each text with candidates, or that several rows have, key, rows, first (the smallest doc_id of
    these, LAST for null) and found, an array of (starts, marks) by stretch. docs: doc_id, text."""
    docs = placed(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", text_key("text"))
    texts = docs.groupBy("key").agg(F.min(F.struct("file", "at")).alias("place"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"), F.count(F.lit(1)).alias("rows"))
    texts = written(texts.select("key", "place.*", "first", "rows"), "repeats-texts")
    table = candidates(docs, texts, units, within)
    verdicts = judged(table.select(*PIECE, "first", (F.size("starts") * F.col("rows")).alias("n")), units, judge)
    joined = table.select("key", "stretch", "starts").join(verdicts.withColumnRenamed("stretch", "__s"), F.col("stretch") == F.col("__s"))
    found = joined.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("starts", "marks")).alias("found"))
    out = texts.join(found, F.col("key") == F.col("__key"), "left").where("rows > 1 OR found IS NOT NULL").select(F.col("key").alias("__key"), "rows", "first", "found")
    out = written(out, "repeats-found")
    spent(table)
    return docs, out


def with_verdicts(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """doc_id, text, rows, first, found: all rows of docs, the last three null where no verdict is."""
    flagged = maybe(docs.select("doc_id", "text", "key"), bit_table(verdicts, "__key"), "key")
    rest = flagged.where("NOT held").select("doc_id", "text", *(F.lit(None).cast(verdicts.schema[c].dataType).alias(c) for c in ("rows", "first", "found")))
    return rest.union(flagged.where("held").join(verdicts, F.col("key") == F.col("__key"), "left").select("doc_id", "text", "rows", "first", "found"))


def marked_windows(found: list[dict] | None, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, marks) of the windows of a text's stretches."""
    for f in found or ():
        marks = np.frombuffer(f["marks"], kind)
        starts = np.array(f["starts"], np.int64)
        yield (starts[:, None] + np.arange(len(marks))).ravel(), np.tile(marks, len(starts))


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of the starts."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + width, n), -1)
    return np.cumsum(depth[:n]) > 0
