"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are taken in the order of their keys: the key space is cut into ranges of
about RANGE_ROWS rows, sizes are summed by range, and prefix sums over ranges and then within a range give each document's place; no task
holds more than one range. A source's budget is its target rounded to whole words. As many whole epochs as fit are taken of every document,
and the rest is cut exactly where the budget ends, in the middle of a document if need be.

Targets: sources in code point order, null last, weigh WEIGHTS in turn; they share `share` times all sizes, but none gets more than `most`
times its own size, the excess going to the others by weight until none is above. With sources ordered by size over weight, that level is the
greatest of (total - caps before) / (weights from here on), which one pass of prefix sums finds; there is a row for each source.

Ties: keys come from doc_id alone (null counts as a value of its own), ties are ordered by size; rows equal in both are interchangeable.
Null and empty texts have size 0 and are taken 0 times. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.llm.common import SPACES, documents, n_words, whole_row, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
RANGE_ROWS = 4096
#: Sources are broadcast up to this many, counted first; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 2000


def hash_key(doc_id: Column) -> Column:
    """60 random bits of a document: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}"))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, n_rows -> the same with target. One row a source, so one task suffices for the order over all of them."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = sources.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(SHARE)
    df = df.withColumn("level", (total - before) / onward)
    level = F.max("level").over(everything)
    return df.withColumn("target", F.round(F.least(F.col("cap").cast("double"), level * F.col("weight")), 6)).select("source", "source_size", "n_rows", "target")


def mix(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size (and any other columns, carried along) -> with source_size, target, epochs (whole ones) and taken (words)."""
    sizes = sizes.withColumn("__key", hash_key(F.col("doc_id")))
    sources = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))), "mix-sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    n = F.ceil(F.col("n_rows") / RANGE_ROWS)
    df = sizes.alias("d").join(sources.withColumnRenamed("source", "__source"), F.col("d.source").eqNullSafe(F.col("__source"))).drop("__source")
    # 32 bits of the key times the number of ranges (up to 2**31): a range is a contiguous part of the key space.
    df = df.withColumn("__range", F.shiftright(F.shiftright("__key", 28) * n, 32))
    ranges = df.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    df = df.join(ranges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))).drop("__s", "__r")
    within = W.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.round("target").cast("long")
    df = df.withColumn("__place", place).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
    rest = budget - F.col("epochs") * F.col("source_size")
    df = df.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__place"))))
    return df.drop("__key", "__range", "__before", "__place", "n_rows")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every document, written once: texts are read a single time."""
    return written(docs.select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of docs as often as its words are taken, columns as they were; where a budget ends inside a text, that text's
    first words stand for it (single spaces between them). Texts without words are not taken. n_chars, if there, follows a cut text."""
    df = mix(docs.select("doc_id", "source", n_words(text).alias("size"), whole_row(docs, "doc"))).where("taken > 0")
    body = F.col("doc")[text]
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    words = F.filter(F.split(body, rf"[{SPACES}]+"), lambda w: w != "")
    cut = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), " "))).otherwise(F.array().cast("array<string>"))
    df = df.select("doc", F.explode(F.concat(F.array_repeat(body, whole), cut)).alias("copy"))
    changed = {text: F.col("copy")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("copy") == body, F.col("doc")["n_chars"]).otherwise(F.char_length("copy").cast(docs.schema["n_chars"].dataType))
    return df.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(sized(documents(spark, sf_dir, "doc_id", "text", "source")))
    return df.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 15) AS BIGINT) AS k
  FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS INT) AS weight
  FROM s GROUP BY source),
l AS (
  SELECT *, {MOST} * source_size AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}
          - CAST(coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM t),
g AS (SELECT source, source_size, round(least(CAST(cap AS DOUBLE), max(level) OVER () * weight), 6) AS target FROM l),
p AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - place)) END AS BIGINT) AS taken
FROM p
"""
