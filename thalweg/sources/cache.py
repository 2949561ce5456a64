"""Tables kept from run to run, under names that tell what they were made of.

A name is the digest of the files that a table comes from (their paths, lengths and times of change, as their folders tell them) and of whatever else it
depends on; a changed input is another name, so nothing kept is ever wrong or overwritten. A table appears by the renaming of its whole folder: readers
see all of it or nothing, and of two makers the first one's stays. Folders of stores that cannot rename at once should not be used.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from thalweg.sources.netcdf import located

LAYOUT = "1"  # another number whenever a kept table's columns or meaning change


def files(path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files of a path, hidden ones apart. No file is opened."""
    system, at = located(path)
    found = system.get_file_info(at)
    listed = system.get_file_info(fs.FileSelector(at, recursive=True)) if found.type == fs.FileType.Directory else [found]
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in listed if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


def digest(paths: list[str], *about) -> str:
    """A name for what is made of these paths and values."""
    return hashlib.sha256(json.dumps([LAYOUT, [files(p) for p in paths], about], default=str).encode()).hexdigest()[:32]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.sc().hadoopConfiguration())


def kept(spark: SparkSession, folder: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name and digest: read, without a job, or made, written and published first."""
    path = f"{folder.rstrip('/')}/{name}-{key}"
    where, system = _folder(spark, path)
    if not system.exists(where):
        df = make()
        hidden = f"{folder.rstrip('/')}/.{name}-{key}-{uuid.uuid4().hex}"
        df.write.parquet(hidden)
        there, _ = _folder(spark, hidden)
        schema, _ = _folder(spark, f"{hidden}/_schema")
        out = system.create(schema)  # read back without looking into a data file
        out.write(bytearray(df.schema.json().encode()))
        out.close()
        if system.exists(where) or not system.rename(there, where):
            system.delete(there, True)  # another run was first
    at, _ = _folder(spark, f"{path}/_schema")
    stream = system.open(at)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(path)


def catalogue(folder: str) -> list[tuple[str, str, int]]:
    """(name, digest, bytes) of what a folder keeps."""
    system, at = located(folder)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    whole = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory and not i.base_name.startswith("."))
    return [(*n.rsplit("-", 1), sum(size for _, size, _ in files(f"{folder.rstrip('/')}/{n}"))) for n in whole]


def forget(spark: SparkSession, folder: str, name: str, key: str) -> None:
    """Deletes a kept table, which nothing may be reading."""
    where, system = _folder(spark, f"{folder.rstrip('/')}/{name}-{key}")
    system.delete(where, True)
