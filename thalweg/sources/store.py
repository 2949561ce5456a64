"""Discharge clustered by watershed and river: a river's series lies in few files of a large table, and a manifest tells which.

Rows are dealt by ranges of (watershed, river, time), so files hold neighbouring rivers, and a river whose rows outgrow a file goes on, in time, in the
next. The manifest has a row a file, with the first and last of its rivers, by place, and of its times; readers of some rivers or of some time open these
files alone. A new table takes the place of an old one only when its manifest is written, as the manifest names the files of one write.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS = 20_000_000
_ENDS = ("watershed_id", "river_id", "time")


def write(df: DataFrame, net: DataFrame, path: str, files: int | None = None, value: str = "q") -> None:
    """Writes river_id, time and a value. net: river_id, watershed_id (network.with_roots). files: how many (default: so that none has over FILE_ROWS
    rows on average). A river that net does not have stops the write; repeated rows stay; no rows make an empty table."""
    known = net.select(F.col("river_id").alias("__r"), "watershed_id")
    missing = F.raise_error(F.lit("discharge of a river that is not in the network")).cast("long")
    rows = df.join(known, F.col("river_id") == F.col("__r"), "left").select(F.coalesce("watershed_id", missing).alias("watershed_id"), "river_id", "time", F.col(value).alias("q"))
    spark, run = df.sparkSession, uuid.uuid4().hex
    files = files or max(1, -(-df.count() // FILE_ROWS))
    data = f"{path.rstrip('/')}/rows-{run}"
    rows.repartitionByRange(files, *_ENDS).sortWithinPartitions(*_ENDS).write.parquet(data)
    ends = [f(c).alias(f"{n}_{c}") for c in _ENDS for n, f in (("first", F.min), ("last", F.max))]
    # Ends of (watershed, river) as pairs: those of either column alone would be wider.
    pair = F.struct("watershed_id", "river_id")
    told = spark.read.schema(rows.schema).parquet(data).withColumn("file", F.col("_metadata.file_path"))
    manifest = told.groupBy("file").agg(*ends, F.min(pair).alias("first"), F.max(pair).alias("last"), F.count(F.lit(1)).alias("n"))
    manifest.withColumn("file", F.element_at(F.split("file", "/"), -1)).withColumn("folder", F.lit(f"rows-{run}")).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: file, folder, n, its first and last (watershed_id, river_id), and the first and last of each column."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def read(spark: SparkSession, path: str, net: DataFrame | None = None, rivers: list[int] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """watershed_id, river_id, time, q of some rivers (net tells their watersheds) and of times from since up to, not including, until. Only files that may hold
    such rows are opened; with neither, all are."""
    files = manifest(spark, path)
    if rivers is not None:
        if net is None:
            raise ValueError("the network is needed to find rivers")
        own = net.where(F.col("river_id").isin(rivers)).select(F.struct("watershed_id", "river_id").alias("__own"))
        files = files.join(F.broadcast(own), F.col("__own").between(F.col("first"), F.col("last")), "left_semi")  # the rivers asked for
    if since is not None:
        files = files.where(F.col("last_time") >= F.lit(since))
    if until is not None:
        files = files.where(F.col("first_time") < F.lit(until))
    base = path.rstrip("/")
    found = [f"{base}/{r['folder']}/{r['file']}" for r in files.select("folder", "file").collect()]  # a name a file to open
    schema = "watershed_id long, river_id long, time timestamp_ntz, q double"
    if not found:
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(*found)
    for wanted in (None if rivers is None else F.col("river_id").isin(rivers), None if since is None else F.col("time") >= F.lit(since), None if until is None else F.col("time") < F.lit(until)):
        df = df if wanted is None else df.where(wanted)
    return df


def sink(net: DataFrame, files: int | None = None):
    """A sink for routers: clustered tables in place of plain ones."""
    return lambda df, path, source: write(df, net, path, files)
