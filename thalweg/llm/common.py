"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.session import shared_dir, spent, written

__all__ = [
    "WORD", "ascii_lower", "ascii_words", "bit_table", "bound", "documents", "map_rows", "maybe", "n_words", "placed", "ranked", "shared_dir", "small_batches", "spent", "text_key", "whole_row", "written",
]

#: A word is a run of anything but these white-space characters.
SPACES = "\x20\x09-\x0d"
WORD = rf"[^{SPACES}]+"
#: Rows turned into Python objects at a time: bounds memory whatever the Arrow batch holds.
SLICE = 128
#: Rows in an Arrow batch between Spark and Python. Texts are long, and each task holds a batch on either side.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """df, after asking its session for Arrow batches that suit whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def whole_row(df: DataFrame, name: str) -> Column:
    """All columns of df as one struct, so that none clashes with what an operator adds; unpacked by select(f"{name}.*")."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))))


def n_words(text: Column | str) -> Column:
    """Words of a text, built-in functions only: pieces between white space, less an empty first and last one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    pieces = F.split(text, rf"[{SPACES}]+", -1)
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


#: What stands between the words of texts compared without regard to case: ASCII but letters and digits. Words are found before letters are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in SQL over lowered texts: what a word is made of.
LOWERED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ascii_lower(word: Column) -> Column:
    """A-Z lowered, nothing else. Spark lowers ASCII fast, and would lower other letters too."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, CAPITALS.lower()))


def ascii_words(text: Column | str) -> Column:
    """The words of a whole text (null: none), not yet lowered. Splitting takes linear time, which extracting all matches does not."""
    pieces = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BETWEEN, -1)

    def inner(p: Column) -> Column:
        first, last = (F.element_at(p, 1) == "").cast("int"), (F.element_at(p, -1) == "").cast("int")
        return F.slice(p, first + 1, F.greatest(F.lit(0), F.size(p) - first - last))

    return bound(pieces, inner)


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with place (1, 2, 3... by `order`) and total (its rows): dealt by range and sorted, each partition's rows counted, and offset by those
    of the partitions before it. No task holds more than a range; order should tell rows apart, so that ranges can be cut anywhere.

    df is read twice; the sorted rows are written.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("total"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(offsets), part == F.col("__p")).withColumn("place", place).drop("__at", "__p", "__before")


def map_rows(df: DataFrame, make: Callable[[], Callable[[str], tuple]], fields: str, text: str = "text") -> DataFrame:
    """df without `text`, with `fields` (DDL) added: make() gives each task a function from one whole text (null: empty) to their values.

    Columns of df whose names a field has, in any case, give way to it. Arrow batches are read in slices of SLICE rows, so that a task holds few
    texts as Python objects.
    """
    new = T._parse_datatype_string(fields).fields
    taken = {f.name.lower() for f in new}
    keep = [f for f in df.schema.fields if f.name != text and f.name.lower() not in taken]
    types = [to_arrow_type(f.dataType) for f in new]
    at, others, names = df.columns.index(text), [df.columns.index(f.name) for f in keep], [f.name for f in [*keep, *new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = [f(x or "") for x in part.column(at).to_pylist()]
                columns = [part.column(i) for i in others] + [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(df).mapInArrow(run, T.StructType([*keep, *new]))


#: Bits of a table that leaves out rows: at most TABLE_BITS / 64 rows of two numbers, whatever the input.
TABLE_BITS = 1 << 24


def placed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Those columns of docs, and where each row is: file (its file's hash) and at (its number there). What is not read from files is written first."""
    try:
        about = docs.metadataColumn("_metadata")
        return docs.select(*columns, F.xxhash64(about["file_path"]).alias("file"), about["row_index"].alias("at"))
    except AnalysisException:
        return placed(written(docs, "placed"), *columns)


def bit_table(rows: DataFrame, *of: str) -> DataFrame:
    """(word, bits): a table of TABLE_BITS bits, those set on which rows fall by the hash of the columns `of`."""
    bit = F.pmod(F.xxhash64(*of), F.lit(TABLE_BITS))
    words = rows.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    return written(words, "bit-table")


def maybe(rows: DataFrame, table: DataFrame, *of: str) -> DataFrame:
    """rows with `held`: false only where none of the rows that made the table has these values. Its size is bounded, so it is broadcast."""
    bit = F.pmod(F.xxhash64(*of), F.lit(TABLE_BITS))
    named = table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    joined = rows.withColumn("__bit", bit).join(F.broadcast(named), F.shiftright("__bit", 6) == F.col("__word"), "left")
    return joined.withColumn("held", F.expr("coalesce(shiftright(__bits, cast(__bit % 64 AS INT)) & 1L, 0L) <> 0")).drop("__bit", "__word", "__bits")
