"""netCDF files of the classic layout (CDF-1, -2 and -5), read and written by Spark tasks.

Reading: a table has a row for each number of a variable. Its columns are those of the schema asked for: variables, coordinates of their dimensions
(a time with units like "hours since ..." as a timestamp), places on a dimension (`<dimension>_index`) and `source`, the file. Only what is asked for
is read. A file's header is read once, on the driver; each task reads one block of numbers, which lie together, by their offset. Blocks follow the first
dimension: those outside of a range asked for (by options, or by filters where Spark pushes them down) are never opened. Fill values become NaN, and
packed numbers are unpacked by scale and offset.

Writing: every number has its place, so the header, all offsets and the file's length are known before a job starts. Rows are dealt and sorted by
place, each task writes its runs of numbers into one hidden file, and the driver's commit checks that every place was filled once, adds
the header and gives the file its name. A task that runs twice writes the same bytes twice; a job that fails leaves nothing.

Files are opened by pyarrow: local or shared folders, and stores that it knows by their scheme. Writing at an offset needs a folder that the driver
and all executors share. netCDF-4 files are HDF5 files and are not read; `nccopy -k cdf5` makes classic ones of them.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.operators.weights import numbered
from thalweg.session import workers_find_package, written

#: Numbers that a reading task takes at most, and that it turns into rows at a time.
BLOCK, BATCH = 1 << 20, 1 << 16

# Fixed values of the file format: tags of the header's lists, and its types by their numbers.
DIMENSIONS, VARIABLES, ATTRIBUTES, CHAR = 10, 11, 12, 2
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def is_netcdf(path: str) -> bool:
    return path.rstrip("/").endswith((".nc", ".nc3", ".cdf"))


# --- files ------------------------------------------------------------------------------------------------------------------------------------


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    local = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), os.path.abspath(local))


def files_of(path: str) -> list[str]:
    """A file, or the netCDF files of a folder in order."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if is_netcdf(i.base_name))
    return [f"{path.rstrip('/')}/{n}" for n in names]


# --- the header -------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Variable:
    """A variable: its dimensions by name, its type's number, and where its numbers begin."""

    name: str
    dims: list[str]
    kind: int
    attributes: dict = field(default_factory=dict)
    begin: int = 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind])


@dataclass
class Header:
    """Dimensions by length, variables, attributes; `record` is the dimension that can grow, of records `stride` bytes apart."""

    dims: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict = field(default_factory=dict)
    record: str | None = None
    stride: int = 0

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d] for d in v.dims]


class _Bytes:
    """Reads a header piece by piece: `size` bytes for counts (8 in CDF-5), offsets of 4 bytes in CDF-1 and 8 otherwise."""

    def __init__(self, file):
        self.file = file
        magic = self.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("this is no netCDF file of the classic layout; netCDF-4 files can be made into one by nccopy -k cdf5")
        self.count, self.place = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")

    def take(self, n: int) -> bytes:
        found = self.file.read(n)
        if len(found) < n:
            raise ValueError("a netCDF header ends early")
        return found

    def number(self, layout: str) -> int:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number(self.count)).decode()

    def entries(self, tag: int) -> range:
        found, n = self.number(">i"), self.number(self.count)
        if found not in (0, tag):
            raise ValueError("a netCDF header is damaged")
        return range(n)

    def attributes(self) -> dict:
        found = {}
        for _ in self.entries(ATTRIBUTES):
            name, kind, n = self.name(), self.number(">i"), self.number(self.count)
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            found[name] = raw.decode(errors="replace") if kind == CHAR else np.frombuffer(raw, TYPES[kind]).tolist()
        return found


def parsed(file) -> Header:
    """The header of an open file."""
    b = _Bytes(file)
    records = b.number(b.count)
    dims = [(b.name(), b.number(b.count)) for _ in b.entries(DIMENSIONS)]
    record = next((d for d, n in dims if n == 0), None)
    attributes, variables, sizes = b.attributes(), [], {}
    for _ in b.entries(VARIABLES):
        name = b.name()
        own = [dims[b.number(b.count)][0] for _ in range(b.number(b.count))]
        about, kind = b.attributes(), b.number(">i")
        b.number(b.count)  # the size, which its dimensions tell as well
        variables.append(Variable(name, own, kind, about, b.number(b.place)))
    header = Header(dict(dims), {v.name: v for v in variables}, attributes, record)
    for v in variables:
        if record and v.dims[:1] == [record]:
            sizes[v.name] = prod(header.shape(v)[1:]) * v.dtype.itemsize
    # A record holds a part of each such variable, filled up to a multiple of 4; of a single variable it is not filled up.
    header.stride = sum(sizes.values()) if len(sizes) == 1 else sum(s + -s % 4 for s in sizes.values())
    if record:
        header.dims[record] = max(0, records) if records >= 0 else (file.size() - min(v.begin for v in variables if v.name in sizes)) // header.stride
    return header


def encoded(header: Header) -> tuple[bytes, int]:
    """(header, the file's length) as CDF-5, no dimension growing; sets where variables begin."""
    number = lambda n: struct.pack(">q", n)
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda s: number(len(s.encode())) + padded(s.encode())

    def entries(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">i", tag if parts else 0) + number(len(parts)) + b"".join(parts)

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            return name(key) + struct.pack(">i", CHAR) + number(len(value.encode())) + padded(value.encode())
        found = np.atleast_1d(np.asarray(value))
        kind = 6 if found.dtype.kind == "f" else 10
        return name(key) + struct.pack(">i", kind) + number(len(found)) + padded(found.astype(TYPES[kind]).tobytes())

    attributes = lambda found: entries(ATTRIBUTES, [attribute(k, v) for k, v in found.items()])
    place = {d: k for k, d in enumerate(header.dims)}

    def whole() -> bytes:
        parts = []
        for v in header.variables.values():
            size = prod(header.shape(v)) * v.dtype.itemsize
            parts.append(name(v.name) + number(len(v.dims)) + b"".join(number(place[d]) for d in v.dims) + attributes(v.attributes) + struct.pack(">i", v.kind) + number(size + -size % 4) + number(v.begin))
        return b"CDF\5" + number(0) + entries(DIMENSIONS, [name(d) + number(n) for d, n in header.dims.items()]) + attributes(header.attributes) + entries(VARIABLES, parts)

    at = len(whole())
    for v in header.variables.values():
        v.begin = at
        size = prod(header.shape(v)) * v.dtype.itemsize
        at += size + -size % 4
    return whole(), at


# --- numbers ----------------------------------------------------------------------------------------------------------------------------------


def numbers(file, header: Header, v: Variable, low: int, high: int) -> np.ndarray:
    """The variable's numbers from place low up to high, as they are stored."""
    size = v.dtype.itemsize
    if header.record is None or v.dims[:1] != [header.record]:
        return np.frombuffer(file.read_at((high - low) * size, v.begin + low * size), v.dtype)
    slab = prod(header.shape(v)[1:])
    parts = []
    for r in range(low // slab, -(-high // slab)):
        a, b = max(low, r * slab) - r * slab, min(high, (r + 1) * slab) - r * slab
        parts.append(file.read_at((b - a) * size, v.begin + r * header.stride + a * size))
    return np.frombuffer(b"".join(parts), v.dtype)


def decoded(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Stored numbers as doubles (integers as long where nothing is unpacked), missing ones NaN; times as microseconds since 1970."""
    about = v.attributes
    first = lambda key, other=None: about[key][0] if isinstance(about.get(key), list) and about[key] else other
    if since := re.match(r"(\w+?)s? since (.+)", about.get("units", "") if isinstance(about.get("units"), str) else ""):
        return times(since[1].lower(), since[2], raw, about.get("calendar", "standard"))
    missing = [m for m in (first("_FillValue"), first("missing_value")) if m is not None]
    scale, offset = first("scale_factor"), first("add_offset")
    if raw.dtype.kind in "iu" and not missing and scale is None and offset is None:
        return raw.astype(np.int64)
    out = raw.astype(np.float64)
    for m in missing:
        out[raw == m] = np.nan
    return out * (1.0 if scale is None else scale) + (0.0 if offset is None else offset)


def times(unit: str, since: str, raw: np.ndarray, calendar: str = "standard") -> np.ndarray:
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"times of the calendar {calendar} have no timestamps")
    if unit not in SECONDS:
        raise ValueError(f"times in {unit}s are not known")
    text = re.sub(r"\s*(UTC|Z|\+00:?00)$", "", since.strip())
    date, _, clock = text.replace("T", " ").partition(" ")
    y, m, d = (int(x) for x in date.split("-"))
    base = np.datetime64(datetime(y, m, d).isoformat() if not clock else datetime.fromisoformat(f"{y:04}-{m:02}-{d:02} {_clock(clock)}"), "us")
    return (base + np.round(raw.astype(np.float64) * SECONDS[unit] * 1e6).astype("timedelta64[us]")).astype(np.int64)


def _clock(text: str) -> str:
    h, m, s = [*text.split(":"), "0", "0"][:3]
    return f"{int(h):02}:{int(m):02}:{float(s):09.6f}"


def is_time(v: Variable | None) -> bool:
    return v is not None and isinstance(v.attributes.get("units"), str) and " since " in v.attributes["units"]


# --- reading ----------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Block(InputPartition):
    """Numbers low to high of the variables of a file, whose header comes along."""

    path: str
    header: Header
    low: int
    high: int

    def __post_init__(self):
        super().__init__((self.path, self.low, self.high))


class Reader(DataSourceReader):
    """Blocks of the variables in a schema."""

    def __init__(self, options: dict, schema: T.StructType):
        self.schema = schema
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.block = int(options.get("block", BLOCK))
        stamp = lambda key: np.datetime64(datetime.fromisoformat(options[key]), "us").astype(np.int64) if options.get(key) else None
        #: (column, test, value): conditions on the first dimension's coordinate, or on its place.
        self.conditions = [(None, op, stamp(key)) for key, op in (("since", ">="), ("until", "<")) if options.get(key)]

    def dims(self, header: Header) -> list[str]:
        """The dimensions of what is asked for: those of the variables, or those whose coordinates are asked for."""
        asked = [f.name for f in self.schema.fields]
        own = [header.variables[n].dims for n in asked if n in header.variables and n not in header.dims]
        found = max(own, key=len) if own else [d for d in header.dims if d in asked or f"{d}_index" in asked]
        for n in asked:
            v = header.variables.get(n)
            if v is not None and n not in header.dims and v.dims != found:
                raise ValueError(f"variables of different dimensions: {n} has {v.dims}, others {found}")
            if v is None and n != "source" and n not in found and n.removesuffix("_index") not in found:
                raise ValueError(f"{n} is neither a variable nor a dimension")
        return found

    def partitions(self) -> list[Block]:
        blocks = []
        for path in [f for p in self.paths for f in files_of(p)]:
            system, at = located(path)
            with system.open_input_file(at) as file:
                header = parsed(file)
                dims = self.dims(header)
                keep = self.kept(file, header, dims[0]) if dims else np.zeros(0, bool)
            slab = prod(header.dims[d] for d in dims[1:])
            # Runs of steps that are kept, cut into blocks of whole steps, or steps into blocks where one is larger.
            edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
            size = max(1, self.block // max(1, slab)) * slab if slab <= self.block else self.block
            for a, b in zip(edges[::2] * slab, edges[1::2] * slab, strict=True):
                blocks += [Block(path, header, int(k), int(min(k + size, b))) for k in range(a, b, size)]
        return blocks

    def kept(self, file, header: Header, dim: str) -> np.ndarray:
        """Which places of the first dimension fulfil all conditions. A coordinate has a number a step."""
        n = header.dims[dim]
        keep = np.ones(n, bool)
        for column, op, value in self.conditions:
            if column == f"{dim}_index":
                own = np.arange(n)
            elif column in (None, dim) and dim in header.variables:
                v = header.variables[dim]
                own = decoded(v, numbers(file, header, v, 0, n))
            else:
                continue
            keep &= {"=": own == value, ">": own > value, ">=": own >= value, "<": own < value, "<=": own <= value}[op]
        return keep

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # what Spark gives where there are no blocks
            return
        header = block.header
        dims = self.dims(header)
        shape = [header.dims[d] for d in dims]
        asked = [f.name for f in self.schema.fields]
        system, at = located(block.path)
        with system.open_input_file(at) as file:
            # Coordinates of the other dimensions have a number a column of a slab; of the first, only the block's are read.
            slab = prod(shape[1:])
            steps = (block.low // slab, -(-block.high // slab))
            axis = {d: decoded(header.variables[d], numbers(file, header, header.variables[d], *(steps if k == 0 else (0, shape[k])))) for k, d in enumerate(dims) if d in asked and d in header.variables}
            for low in range(block.low, block.high, BATCH):
                high = min(low + BATCH, block.high)
                place = dict(zip(dims, np.unravel_index(np.arange(low, high), shape), strict=True))
                columns = []
                for f in self.schema.fields:
                    v = header.variables.get(f.name)
                    if f.name in place:
                        own = place[f.name] - (steps[0] if f.name == dims[0] else 0)
                        found = axis[f.name][own] if f.name in axis else place[f.name]
                    elif v is not None:
                        found = decoded(v, numbers(file, header, v, low, high))
                    elif f.name == "source":
                        columns.append(pa.array([block.path] * (high - low)))
                        continue
                    else:
                        found = place[f.name.removesuffix("_index")]
                    kind = to_arrow_type(f.dataType)
                    columns.append(pa.array(found).cast(kind) if not pa.types.is_timestamp(kind) else pa.array(found, pa.int64()).cast(pa.timestamp("us")).cast(kind))
                yield pa.RecordBatch.from_arrays(columns, names=asked)


TESTS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class PrunedReader(Reader):
    """The same where Spark hands its filters down. All stay with Spark too: here they only spare blocks."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1:
                value = np.datetime64(f.value, "us").astype(np.int64) if isinstance(f.value, datetime) else f.value
                self.conditions.append((f.attribute[0], TESTS[type(f)], value))
            yield f


class Netcdf(DataSource):
    """format("netcdf"): options path, or paths (JSON), block, since, until."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        """The first file's variable with the most dimensions, and the coordinates of these."""
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        system, at = located(next(f for p in paths for f in files_of(p)))
        with system.open_input_file(at) as file:
            header = parsed(file)
        v = max((v for n, v in header.variables.items() if n not in header.dims), key=lambda v: len(v.dims))
        own = {d: header.variables.get(d) for d in v.dims}
        kinds = {d: T.TimestampNTZType() if is_time(x) else T.DoubleType() if x is not None and x.dtype.kind == "f" else T.LongType() for d, x in own.items()}
        return T.StructType([*(T.StructField(d, k) for d, k in kinds.items()), T.StructField(v.name, T.DoubleType())])

    def reader(self, schema: T.StructType) -> Reader:
        return (PrunedReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def registered(spark: SparkSession) -> SparkSession:
    workers_find_package(spark)
    spark.dataSource.register(Netcdf)
    return spark


def read(spark: SparkSession, paths: list[str], schema: str, since: datetime | None = None, until: datetime | None = None, block: int = BLOCK) -> DataFrame:
    """The columns of `schema` (DDL) from files or folders; of times from `since` on and before `until`, if given."""
    given = {"paths": json.dumps(paths), "block": str(block), "pushdown": spark.conf.get(PUSHDOWN, "false")}
    given |= {k: v.isoformat() for k, v in (("since", since), ("until", until)) if v}
    return registered(spark).read.format("netcdf").schema(schema).options(**given).load()


# --- writing ----------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Filled(WriterCommitMessage):
    """How many places a task has filled."""

    n: int


class Writer(DataSourceArrowWriter):
    """Rows (place, coordinates, values), sorted by place, into one file at their offsets."""

    def __init__(self, options: dict):
        about = json.loads(options["layout"])
        system, self.path = located(options["path"])
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("netCDF files are written to folders that the driver and all executors share")
        self.hidden = os.path.join(os.path.dirname(self.path), f".{os.path.basename(self.path)}-{uuid.uuid4().hex}")
        variables = {v["name"]: Variable(v["name"], v["dims"], v["kind"], v["attributes"]) for v in about["variables"]}
        self.header = Header(about["dims"], variables, about["attributes"])
        self.raw, self.length = encoded(self.header)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Filled:
        shape, dims = list(self.header.dims.values()), list(self.header.dims)
        file, n, before = os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644), 0, -1
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                place = batch.column(0).to_numpy()
                if place[0] <= before or (np.diff(place) <= 0).any():
                    raise ValueError("a place of a netCDF file is given twice")
                before, n = place[-1], n + len(place)
                where = np.unravel_index(place, shape)
                for k, v in enumerate(self.header.variables.values(), 1):
                    found = batch.column(k).to_numpy(zero_copy_only=False)
                    at = place
                    if v.name in dims:  # a coordinate stands in the rows that are first on all other dimensions
                        own = dims.index(v.name)
                        rows = np.flatnonzero(np.all([w == 0 for i, w in enumerate(where) if i != own], axis=0)) if len(dims) > 1 else np.arange(len(place))
                        at, found = where[own][rows], found[rows]
                    self.put(file, v, at, found)
        finally:
            os.close(file)
        return Filled(n)

    def put(self, file: int, v: Variable, at: np.ndarray, found: np.ndarray) -> None:
        """Runs of places that follow one another are written at once."""
        edges = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                os.pwrite(file, found[a:b].astype(v.dtype).tobytes(), v.begin + int(at[a]) * v.dtype.itemsize)

    def commit(self, messages: list[Filled | None]) -> None:
        n, want = sum(m.n for m in messages if m), prod(self.header.dims.values())
        if n != want:
            raise ValueError(f"a netCDF file of {want} places got {n} rows: every combination of its dimensions must be there once")
        file = os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.ftruncate(file, self.length)
            os.pwrite(file, self.raw, 0)
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Filled | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


def write(df: DataFrame, path: str, dims: dict[str, str], values: dict[str, str], attributes: dict | None = None, about: dict[str, dict] | None = None) -> None:
    """Writes df as one file of the layout CDF-5.

    dims: columns that are dimensions, in order, by what their coordinates are stored as ("time", "long", "double", or "place": numbered only). values:
    columns of df by "float", "double" or "long". Every combination of the dimensions' values must be there once. about: attributes by variable.
    """
    spark, about = registered(df.sparkSession), about or {}
    kinds = {"float": 5, "double": 6, "long": 10, "time": 6}
    rows = written(df.select(*dims, *values), "netcdf-rows")
    sizes, place, variables, columns = {}, F.lit(0).cast("long"), [], []
    for d, kind in dims.items():
        own = written(numbered(rows.select(F.col(d).alias("__d")).distinct(), "__d", name="__n"), "netcdf-dimension")
        first, n = own.agg(F.min("__d"), F.count(F.lit(1))).first()
        own = own.select(F.col("__d").alias(f"__{d}"), (F.col("__n") - 1).alias(f"__{d}_place"))
        rows = rows.join(own, F.col(d) == F.col(f"__{d}"))
        sizes[d], place = n, place * n + F.col(f"__{d}_place")
        if kind == "place":
            continue
        since = {"units": f"seconds since {first:%Y-%m-%d %H:%M:%S}", "calendar": "standard"} if kind == "time" and first is not None else {}
        variables.append({"name": d, "dims": [d], "kind": kinds[kind], "attributes": since | about.get(d, {})})
        columns.append(_seconds(F.col(d), first) if kind == "time" else F.col(d).cast(kind))
    for name, kind in values.items():
        variables.append({"name": name, "dims": list(dims), "kind": kinds[kind], "attributes": about.get(name, {})})
        columns.append(F.coalesce(F.col(name).cast("double"), F.lit(float("nan"))) if kind != "long" else F.col(name).cast("long"))
    layout = {"dims": sizes, "variables": variables, "attributes": attributes or {}}
    out = rows.select(place.alias("place"), *(c.alias(f"c{k}") for k, c in enumerate(columns)))
    out = out.repartitionByRange("place").sortWithinPartitions("place")
    out.write.format("netcdf").option("layout", json.dumps(layout)).option("path", path).mode("append").save()


def _seconds(time: Column, first: datetime | None) -> Column:
    return (F.timestamp_diff("MICROSECOND", F.lit(first).cast("timestamp_ntz"), time) / 1e6).cast("double")
