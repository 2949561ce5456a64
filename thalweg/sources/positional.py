"""Files without ids, whose rows or columns stand for the rivers of a parameter table in its order.

A table's rows are numbered over all of its files: by their places in a file, which Parquet tells, and what the files before it hold. Kernels in
this form are sparse matrices of steps by rivers, as scipy.sparse.save_npz lays them out: a zip archive of arrays `format`, `shape` and `data`, with
`indices` and `indptr` (csr, csc) or `row` and `col` (coo). Tasks read ranges of entries by their places, and nothing whole: archives may also be
deflated, in which case a task inflates what is before its range. Files of one kernel hold rivers one after the other, in order of their names.
"""

from __future__ import annotations

import io as bytes_io
import math
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.session import written
from thalweg.sources.netcdf import located

#: Entries of a matrix that one task reads, and numbers that it holds of an array at a time.
ENTRIES, PIECE = 1 << 20, 1 << 18


# --- tables -----------------------------------------------------------------------------------------------------------------------------------


def numbered_rows(df: DataFrame) -> DataFrame:
    """A table as read from Parquet files, with `position`: the number of each row from 0, files in order of their names. Rows stay where they are."""
    told = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    held = told.groupBy(F.col("__file").alias("__own")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__own").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    starts = held.select("__own", F.coalesce(before, F.lit(0)).alias("__start"))
    return told.join(starts, F.col("__file") == F.col("__own")).withColumn("position", F.col("__start") + F.col("__row")).drop("__file", "__row", "__own", "__start")


def aligned(rows: DataFrame, net: DataFrame, what: str) -> DataFrame:
    """rows (position, ...) with the river_id of net (river_id, position); as many rows as rivers, or the query stops."""
    if "position" not in net.columns:
        raise ValueError(f"{what} has no river ids, and the network no positions")
    own = net.select("river_id", F.col("position").alias("__p"))
    misfit = F.raise_error(F.lit(f"{what} has not as many rows as the network has rivers")).cast("long")
    both = own.join(rows, F.col("__p") == F.col("position"), "full_outer")
    river = F.when(F.col("river_id").isNull() | F.col("position").isNull(), misfit).otherwise(F.col("river_id"))
    return both.withColumn("river_id", river).drop("__p", "position")


def channel_state(spark: SparkSession, path: str, net: DataFrame) -> DataFrame:
    """river_id, q of a table of one column. Nulls stay null."""
    df = spark.read.parquet(path)
    if len(df.columns) != 1:
        raise ValueError(f"a state without river ids has one column, {path} has {len(df.columns)}")
    rows = numbered_rows(df).select("position", F.col(f"`{df.columns[0]}`").cast("double").alias("q"))
    return aligned(rows, net, "the channel state").select("river_id", "q")


def kernel_state(spark: SparkSession, path: str, net: DataFrame) -> DataFrame:
    """river_id, state of a table with a row a river and a column a step, named by its number."""
    df = spark.read.parquet(path)
    if not all(c.isdecimal() for c in df.columns):
        raise ValueError(f"a carry-over without river ids has columns named by their steps, not {df.columns}")
    steps = sorted(df.columns, key=int)
    rows = numbered_rows(df).select("position", F.array(*(F.col(f"`{c}`").cast("double") for c in steps)).alias("state"))
    return aligned(rows, net, "the carry-over").select("river_id", "state")


# --- kernels ----------------------------------------------------------------------------------------------------------------------------------


def npz_files(path: str) -> list[str]:
    """An archive, or those of a folder in order; none where there are none."""
    if path.rstrip("/").endswith(".npz"):
        return [path]
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    return [f"{path.rstrip('/')}/{n}" for n in sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".npz"))]


class Archive:
    """Arrays of an archive, by ranges of their numbers."""

    def __init__(self, path: str):
        system, at = located(path)
        self.file = system.open_input_file(at)
        self.zip = zipfile.ZipFile(self.file)

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _opened(self, name: str) -> tuple[zipfile.ZipExtFile, int, np.dtype]:
        array = self.zip.open(f"{name}.npy")
        header = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(array) == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = header(array)
        return array, math.prod(shape), dtype

    def size(self, name: str) -> int:
        array, n, _ = self._opened(name)
        array.close()
        return n

    def pieces(self, name: str, low: int = 0, high: int | None = None) -> Iterator[np.ndarray]:
        """The numbers from low up to high, a piece after the other."""
        array, n, dtype = self._opened(name)
        with array:
            array.seek(array.tell() + low * dtype.itemsize)
            for start in range(low, n if high is None else high, PIECE):
                yield np.frombuffer(array.read((min(n if high is None else high, start + PIECE) - start) * dtype.itemsize), dtype)

    def all(self, name: str) -> np.ndarray:
        """A small array as a whole."""
        return np.concatenate(list(self.pieces(name)))

    def about(self) -> tuple[str, int, int, int]:
        """Layout, steps, rivers, entries."""
        layout = self.all("format")[0]
        layout = layout.decode() if isinstance(layout, bytes) else str(layout)
        if layout not in ("csr", "csc", "coo"):
            raise ValueError(f"a kernel of the layout {layout} is none of csr, csc, coo")
        shape = self.all("shape")
        if len(shape) != 2:
            raise ValueError("a kernel has two dimensions")
        return layout, int(shape[0]), int(shape[1]), self.size("data")

    def major(self, low: int, high: int) -> np.ndarray:
        """The row (csr) or column (csc) of entries low up to high: how many begin at or before each."""
        entries, begun = np.arange(low, high), np.full(high - low, -1, np.int64)
        for starts in self.pieces("indptr"):
            if starts[0] >= high:
                break
            begun += len(starts) if starts[-1] <= low else np.searchsorted(starts, entries, side="right")
        return begun

    def entries(self, layout: str, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(step, river's place, value) of entries low up to high."""
        names = ("row", "col") if layout == "coo" else ("indices",)
        done, major = low, None if layout == "coo" else self.major(low, high)
        for values, *places in zip(self.pieces("data", low, high), *(self.pieces(n, low, high) for n in names), strict=True):
            if major is not None:
                own = major[done - low : done - low + len(values)]
                places = [own, places[0]] if layout == "csr" else [places[0], own]
            yield places[0], places[1], values
            done += len(values)


#: Archives whose headers one task reads.
HEADERS = 64


def headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """k (a file's number), path, layout, steps, rivers, entries of archives, from their headers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                with Archive(path) as a:
                    found.append(a.about())
            yield pdf.assign(**{c: [x[i] for x in found] for i, c in enumerate(("layout", "steps", "rivers", "entries"))})

    named = spark.createDataFrame(list(enumerate(files)), "k long, path string").repartition(math.ceil(len(files) / HEADERS))
    return named.mapInPandas(read, "k long, path string, layout string, steps long, rivers long, entries long")


def kernels(spark: SparkSession, files: list[str], net: DataFrame) -> DataFrame:
    """river_id, kernel of sparse archives. net: river_id, position. Entries of one place are summed; places without an entry are 0."""
    if "position" not in net.columns:
        raise ValueError("a kernel without river ids needs the network's positions")
    about = written(headers(spark, files), "kernel-files")
    steps, longest, rivers, n = about.agg(F.min("steps"), F.max("steps"), F.sum("rivers"), F.sum("entries")).first()
    if steps != longest:
        raise ValueError(f"kernels of one length are needed, not of {steps} to {longest} steps")
    if rivers != net.count():
        raise ValueError(f"kernels of {rivers} rivers do not fit a network of {net.count()}")
    before = F.sum("rivers").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    ranges = about.where("entries > 0").withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("entries") - 1, F.lit(ENTRIES).cast("long"))))
    first = about.select(F.col("k").alias("__k"), F.coalesce(before, F.lit(0)).alias("start"))
    blocks = ranges.join(first, F.col("k") == F.col("__k")).select("path", "layout", "start", "low", F.least("entries", F.col("low") + ENTRIES).alias("high"))
    tasks = max(1, math.ceil(n / ENTRIES), min(len(files), spark.sparkContext.defaultParallelism))  # small archives share one

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, layout, start, low, high in pdf.itertuples(index=False):
                with Archive(path) as a:
                    for step, river, u in a.entries(layout, low, high):
                        yield pd.DataFrame({"position": river.astype(np.int64) + start, "step": step.astype(np.int32), "u": u.astype(float)})

    found = blocks.repartition(tasks, "path", "low").mapInPandas(read, "position long, step int, u double").repartition("position").groupBy("position", "step").agg(F.sum("u").alias("u"))
    sparse = found.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("step", "u"))).alias("k"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    gap = lambda p, i: p["step"] - F.coalesce(F.get("k", i - 1)["step"], F.lit(-1)) - 1
    filled = F.flatten(F.transform("k", lambda p, i: F.concat(zeros(gap(p, i)), F.array(p["u"]))))
    dense = sparse.select(F.col("position").alias("__p"), F.concat(filled, zeros(F.lit(steps - 1) - F.element_at("k", -1)["step"])).alias("kernel"))
    return net.select("river_id", "position").join(dense.hint("merge"), F.col("position") == F.col("__p"), "left").select("river_id", F.coalesce("kernel", zeros(F.lit(steps))).alias("kernel"))


def write_kernels(kernel: DataFrame, net: DataFrame, folder: str, rivers: int = 100_000) -> list[str]:
    """Writes kernels (river_id, step, u) as archives (csc) of so many rivers of net (river_id, position) each, a task an archive; gives their paths.

    What is 0 is left out. An archive gets its name only once it is whole, so a task that runs again does no harm.
    """
    steps, n = (kernel.agg(F.max("step")).first()[0] or 0) + 1, net.count()
    system, at = located(folder)
    system.create_dir(at, recursive=True)
    # Spark takes the steps of kernels for few, as they come from few rivers, and would broadcast them all.
    own = net.select("river_id", "position").join(kernel.where("u <> 0").select("river_id", "step", "u").hint("merge"), "river_id", "left")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * rivers
        pdf = pdf.dropna(subset=["step"]).sort_values(["position", "step"])
        starts = np.searchsorted(pdf["position"].to_numpy() - low, np.arange(min(rivers, n - low) + 1))
        out = bytes_io.BytesIO()
        np.savez_compressed(out, indices=pdf["step"].to_numpy(np.int32), indptr=starts.astype(np.int64), format=np.array(b"csc"), shape=np.array([steps, len(starts) - 1]), data=pdf["u"].to_numpy(float))
        path = f"{folder.rstrip('/')}/kernel-{int(key[0]):08d}.npz"
        system, at = located(path)
        hidden = f"{at}.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as f:
            f.write(out.getvalue())
        system.move(hidden, at)
        return pd.DataFrame({"path": [path]})

    named = own.groupBy(F.floor(F.col("position") / rivers).alias("k")).applyInPandas(write, "path string")
    return sorted(r["path"] for r in named.collect())  # a name an archive
