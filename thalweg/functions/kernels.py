"""Unit hydrographs: kernels from dimensionless tables, and convolution of lateral inflow with them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NRCS National Engineering Handbook, Part 630, Chapter 16, Table 16-1 (time over time to peak, flow over peak flow).
TRIANGULAR = ((0.0, 1.0, 2.67), (0.0, 1.0, 0.0))
CURVILINEAR = (
    (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0, 4.5, 5.0),
    (0.000, 0.015, 0.075, 0.160, 0.280, 0.430, 0.600, 0.770, 0.890, 0.970, 1.000, 0.980, 0.920, 0.840, 0.750, 0.660, 0.560, 0.460, 0.390, 0.330, 0.280, 0.207, 0.147, 0.107, 0.077, 0.055, 0.040, 0.029, 0.021, 0.015, 0.011, 0.005, 0.000),
)
TABLES = {"triangular": TRIANGULAR, "curvilinear": CURVILINEAR}


def ramps(table: tuple) -> list[tuple[float, float, float]]:
    """(start, width, volume) of each segment of a table's cumulative volume, which is taken as linear between its nodes."""
    t, q = table
    return [(a, b - a, (b - a) * (p + r) / 2) for a, b, p, r in zip(t, t[1:], q, q[1:], strict=False)]


def cumulative(z: Column, table: tuple) -> Column:
    """The cumulative volume at z: what of each segment lies below it."""
    parts = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("s", "w", "v"), strict=True))) for r in ramps(table)))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["v"] / p["w"] * F.least(F.greatest(z - p["s"], F.lit(0.0)), p["w"]))


def kernel(basins: DataFrame, tr: float, shape: str = "curvilinear") -> DataFrame:
    """river_id, step, u: mean flow in each interval of tr seconds per metre of runoff. basins: river_id, tc (s), area (m2).

    All basins get as many steps as the longest needs; their kernels sum to area / tr.
    """
    if tr <= 0:
        raise ValueError("tr must be positive")
    table = TABLES[shape]
    last, total = table[0][-1], sum(r[2] for r in ramps(table))
    tp = 0.6 * F.col("tc") + tr / 2
    longest = basins.agg(F.max(tp)).first()[0]
    steps = math.ceil(last * longest / tr) if longest is not None else 0
    volume = lambda i: cumulative(F.least(i * tr, F.lit(last) * F.col("tp")) / F.col("tp"), table)
    # Few rows become many: they are dealt to all cores first.
    dealt = basins.select("river_id", "area", tp.alias("tp")).repartition(basins.sparkSession.sparkContext.defaultParallelism, "river_id")
    df = dealt.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max(0, steps - 1)))))
    return df.select("river_id", "step", ((volume(F.col("step") + 1) - volume(F.col("step"))) * F.col("area") / total / tr).alias("u"))


def packed(df: DataFrame, order: str, value: str, name: str, *keys: str) -> DataFrame:
    """Long rows as one array a key, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*(keys or ("river_id",))).agg(F.transform(pairs, lambda p: p[value]).alias(name))


#: Rows that a task packs at once.
PACK = 1 << 19


def runs(batches: Iterator[pa.RecordBatch], *keys: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (keys, t, v) as arrays by key, in order of t, of `size` (PACK) rows or a little more at a time."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        numbers = [x if pa.types.is_integer(x.type) and not x.null_count else x.dictionary_encode(null_encoding="encode").indices for x in (rows.column(k).chunk(0) for k in keys)]
        numbers, t = [x.to_numpy(zero_copy_only=False) for x in numbers], rows.column("t").chunk(0).to_numpy(zero_copy_only=False)
        later, same = np.zeros(len(t) - 1, bool), np.ones(len(t) - 1, bool)
        for x in (*numbers, t):
            later, same = later | same & (x[1:] > x[:-1]), same & (x[1:] == x[:-1])
        if not (later | same).all():
            order = np.lexsort((t, *reversed(numbers)))
            rows, numbers = rows.take(pa.array(order)).combine_chunks(), [x[order] for x in numbers]
        changes = reduce(np.logical_or, [x[1:] != x[:-1] for x in numbers])
        starts = np.flatnonzero(np.concatenate([[True], changes]))
        offsets = pa.array(np.append(starts, len(t)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).chunk(0)) for c in ("t", "v")]
        return pa.RecordBatch.from_arrays([*(rows.column(k).chunk(0).take(pa.array(starts)) for k in keys), *lists], [*keys, "t", "v"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= (size or PACK):
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def packed_rows(lateral: DataFrame, *keys: str) -> DataFrame:
    """packed() of long series: river_id, (keys), v from rows with t. Tasks pack what they hold before it is dealt by river, so that only arrays are shuffled."""
    keys = ("river_id", *keys)
    rows = lateral.select(*keys, F.col("t").cast("int"), F.col("v").cast("double"))
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.DoubleType()))])
    parts = rows.mapInArrow(lambda batches, size=PACK: runs(batches, *keys, size=size), schema).repartition("river_id")
    listed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"), "t", "v"))).alias("__parts"))
    follows = F.forall(F.sequence(F.lit(1), F.size("__parts") - 1), lambda i: F.get("__parts", i)["first"] > F.get("__parts", i - 1)["last"])
    each = F.flatten(F.transform("__parts", lambda p: F.arrays_zip(p["t"].alias("t"), p["v"].alias("v"))))
    mixed = F.transform(F.sort_array(each), lambda p: p["v"])
    ends = F.when(F.size("__parts") == 1, F.get("__parts", F.lit(0))["v"]).when(follows, F.flatten(F.col("__parts.v"))).otherwise(mixed)
    return listed.select(*keys, ends.alias("v"))


def convolve(lateral: DataFrame, kernels: DataFrame, state: DataFrame | None = None, keys: tuple[str, ...] = ("river_id",)) -> DataFrame:
    """keys, v, state: convolved series and the carry-over for a next call. lateral: keys and v (array); kernels and state: river_id and an array.

    A state must have its kernel's length. The convolution is direct, and a series is one row: for kernels that are short beside series, and
    series that fit a row. convolve_blocks does the rest.
    """
    df = lateral.join(kernels.withColumnRenamed("kernel", "__kernel"), "river_id", "left")
    if state is not None:
        df = df.join(state.select("river_id", F.col("state").alias("__state")), "river_id", "left")
    else:
        df = df.withColumn("__state", F.lit(None).cast("array<double>"))
    df = df.select(*keys, "v", "__kernel", "__state")

    def run(batches):
        for pdf in batches:
            out, carry = [], []
            for v, k, s in zip(pdf["v"], pdf["__kernel"], pdf["__state"], strict=True):
                if k is None:
                    raise ValueError("a river has no kernel")
                if s is not None and len(s) != len(k):
                    raise ValueError(f"a state of {len(s)} steps does not fit a kernel of {len(k)}")
                whole = np.concatenate([np.convolve(v, k), [0.0]])
                if s is not None:
                    whole[: len(k)] += s
                out.append(whole[: len(v)])
                carry.append(whole[len(v) :])
            yield pdf[list(keys)].assign(v=out, state=carry)

    return df.mapInPandas(run, df.select(*keys, "v").schema.add("state", T.ArrayType(T.DoubleType())))


#: Numbers that one transform holds at once: rows of an Arrow batch are transformed in groups of so many.
TRANSFORM_NUMBERS = 1 << 21


def block_length(longest: int) -> int:
    """Steps of a block for kernels of up to so many: a block and its tail fill a power of two, at least four kernels long."""
    longest = max(1, longest)
    return 2 ** max(8, math.ceil(math.log2(4 * longest))) - longest + 1


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def transformed(v: pd.Series, kernel: pd.Series, last: pd.Series) -> pd.Series:
    """The last `last` numbers of each pair's whole convolution, as a product in the frequency domain."""
    if kernel.isna().any():
        raise ValueError("a river has no kernel")
    sizes = v.map(len).to_numpy() + kernel.map(len).to_numpy() - 1
    width = 2 ** math.ceil(math.log2(max(2, sizes.max(initial=2))))
    group, out = max(1, TRANSFORM_NUMBERS // width), []
    for a in range(0, len(v), group):
        spectra = []
        for side in (v, kernel):
            own = side.iloc[a : a + group]
            padded = np.zeros((len(own), width))
            for row, x in zip(padded, own, strict=True):
                row[: len(x)] = x
            spectra.append(np.fft.rfft(padded))
        both = np.fft.irfft(spectra[0] * spectra[1], width)
        out += [row[n - k : n].copy() for row, n, k in zip(both, sizes[a : a + group], last.iloc[a : a + group], strict=True)]
    return pd.Series(out, index=v.index, dtype=object)


def convolve_blocks(lateral: DataFrame, kernels: DataFrame, state: DataFrame | None = None, keys: tuple[str, ...] = ("river_id",), block: int | None = None) -> DataFrame:
    """keys, first, v, state: convolved series in blocks of time (first: the step of v's first number). lateral: keys, t (from 0), v.

    Blocks are convolved in the frequency domain, each with what of the block before it still reaches into it (overlap-save: adding the tails of
    convolved blocks gives the same, but would shuffle them once more). Series are dealt once, by river: blocks, their predecessors and kernels meet in
    that partitioning, and no row is longer than a block and a kernel. Only a series' last block has a state, the carry-over for a next call; the other
    blocks' is null. block: steps of a block, at least the longest kernel's (default: block_length).

    Nulls and what is not a number count as 0. A missing or repeated step, a river without a kernel and a state of another length than its kernel stop
    the query. No rows give no rows.
    """
    longest = kernels.agg(F.max(F.size("kernel"))).first()[0] or 1
    block = max(block or block_length(longest), longest)
    rows = lateral.select(*keys, "t", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("v")).repartition("river_id")
    blocks = rows.groupBy(*keys, F.floor(F.col("t") / block).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("v"))
    broken = F.raise_error(F.lit("a series has missing or repeated steps"))
    in_step = F.transform("v", lambda p, i: F.when(p["t"] == F.col("__block") * block + i, p["v"]).otherwise(broken.cast("double")))
    by = W.partitionBy(*keys).orderBy("__block")
    before = F.struct("__block", "v")
    blocks = blocks.withColumn("v", in_step).select("*", F.lag(before).over(by).alias("__before"), F.lead("__block").over(by).isNull().alias("__final"))
    blocks = blocks.join(kernels.select("river_id", F.col("kernel").alias("__kernel")), "river_id", "left")
    if state is not None:
        blocks = blocks.join(state.select("river_id", F.col("state").alias("__state")), "river_id", "left")
    else:
        blocks = blocks.withColumn("__state", F.lit(None).cast("array<double>"))
    n, size = F.size("v"), F.size("__kernel")
    misfit = F.raise_error(F.lit("a state does not fit its kernel")).cast("array<double>")
    carry = F.when(F.col("__block") == 0, F.when(F.size("__state") == size, F.col("__state")).when(F.col("__state").isNotNull(), misfit))
    # A block follows a whole one of the number before it, or is the first.
    follows = F.coalesce((F.col("__block") == F.col("__before.__block") + 1) & (F.size("__before.v") == block), F.col("__block") == 0)
    reach = F.slice("__before.v", F.lit(block + 2) - size, size - 1)  # what the block before has at its end
    longer = F.when(~follows, broken.cast("array<double>")).otherwise(F.concat(F.coalesce(reach, F.array().cast("array<double>")), F.col("v")))
    whole = blocks.select(*keys, "__block", n.alias("__n"), size.alias("__size"), "__final", carry.alias("__carry"), transformed(longer, "__kernel", n + size - 1).alias("__whole"))
    carried = F.zip_with("__whole", "__carry", lambda a, b: a + F.coalesce(b, F.lit(0.0)))  # what is carried over is not the longer one
    whole = whole.withColumn("__whole", F.when(F.col("__carry").isNull(), F.col("__whole")).otherwise(carried))
    rest = F.concat(F.slice("__whole", F.col("__n") + 1, F.col("__size") - 1), F.array(F.lit(0.0)))
    return whole.select(*keys, (F.col("__block") * block).cast("int").alias("first"), F.slice("__whole", F.lit(1), F.col("__n")).alias("v"), F.when(F.col("__final"), rest).alias("state"))


def by_step(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, t, v of convolve_blocks()."""
    keys = keys or ("river_id",)
    # Blocks are never empty; an inner explode would have each worked out once more, to see that.
    return blocks.select(*keys, F.posexplode_outer("v").alias("__p", "v"), "first").select(*keys, (F.col("first") + F.col("__p")).alias("t"), "v")


class Incremental:
    """One step at a time for one river: adds a step's runoff to the carry-over, gives its first value and moves on."""

    def __init__(self, kernel: np.ndarray, state: np.ndarray | None = None):
        self.kernel = np.asarray(kernel, float)
        self.state = np.zeros_like(self.kernel) if state is None else np.array(state, float)

    def step(self, runoff: float) -> float:
        whole = self.state + self.kernel * runoff
        self.state = np.append(whole[1:], 0.0)
        return float(whole[0])


def convolve_incrementally(lateral: DataFrame, kernels: DataFrame, keys: tuple[str, ...] = ("river_id",)) -> DataFrame:
    """As convolve without a state, but step by step."""
    df = lateral.join(kernels.withColumnRenamed("kernel", "__kernel"), "river_id").select(*keys, "v", "__kernel")

    def run(batches):
        for pdf in batches:
            out, carry = [], []
            for v, k in zip(pdf["v"], pdf["__kernel"], strict=True):
                one = Incremental(k)
                out.append([one.step(x) for x in v])
                carry.append(one.state)
            yield pd.DataFrame(pdf[list(keys)]).assign(v=out, state=carry)

    return df.mapInPandas(run, df.select(*keys, "v").schema.add("state", T.ArrayType(T.DoubleType())))
