"""Importance resampling towards a target distribution, with DataFrame functions only.

Features of a text are its runs of 1 to `longest` words (ASCII letters lowered, joined by a space), repeats included; a feature's bucket is its
CRC-32 modulo `buckets`. Buckets are counted over all documents and over all target texts, a row a bucket after partial aggregation. A bucket's
gain is the logarithm of its smoothed probability among the targets over that among the documents, in floored thousandths; the table of gains has
`buckets` rows whatever the input and is broadcast. A document's weight is the sum of its features' gains, its score that plus Gumbel noise from a
hash of its id, and the highest scores are drawn: the same as drawing without replacement with probabilities by weight.

Ranks come from a sort by ranges and each partition's offset (common.ranked). Ties: the smaller doc_id, null last, then more features; rows equal in all
of that are interchangeable and take ranks of their own. Null and empty texts have no feature, weight 0, and are never drawn. A null doc_id hashes as the word null.
An empty table gives an empty result; no target texts leave all gains to the documents' own counts. Texts of any length are read once for counts
and once for weights, and only sums are shuffled. Of other columns only `drawn_documents` takes note: it keeps them all, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.llm.common import CAPITALS, LOWERED_WORD, ascii_lower, ascii_words, bound, documents, placed, ranked, whole_row, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"


def features(text: Column | str, longest: int = LONGEST) -> Column:
    """The features of a text, not yet lowered."""
    words = ascii_words(text)
    if longest == 1:
        return words

    def runs(w: Column) -> Column:
        def of(n: Column) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), of))

    return bound(words, runs)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(ascii_lower(feature).cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text: str = "text") -> DataFrame:
    """bucket, n: features of all texts."""
    each = texts.select(F.explode(features(text, longest)).alias("feature")).select(bucket(F.col("feature"), buckets).alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket, from the counts of the documents and of the target."""
    n = lambda df, name: df.select(F.col("bucket").alias(f"__{name}"), F.col("n").alias(name))
    each = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = each.join(n(own, "s"), F.col("bucket") == F.col("__s"), "left").join(n(target, "t"), F.col("bucket") == F.col("__t"), "left").na.fill(0, ["s", "t"])
    double = lambda c: c.cast("double")
    everything = W.partitionBy()  # `buckets` rows
    all_s, all_t = F.sum("s").over(everything), F.sum("t").over(everything)
    ratio = double(F.col("t") + 1) * double(all_s + buckets) / (double(F.col("s") + 1) * double(all_t + buckets))
    return each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, file, at, n_words, n_features, weight of every row. docs: doc_id, text, file, at (common.placed); table: bucket, gain."""
    found = features("text", longest)
    # A row without features still comes through, once.
    each = docs.select("doc_id", "file", "at", F.explode_outer(found).alias("feature")).withColumn("__bucket", bucket(F.col("feature"), buckets))
    each = each.join(F.broadcast(table), F.col("__bucket") == F.col("bucket"), "left")
    word = F.col("feature").isNotNull() & (~F.contains("feature", F.lit(" ")) if longest > 1 else F.lit(True))
    return each.groupBy("doc_id", "file", "at").agg(F.count_if(word).alias("n_words"), F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in floored thousandths, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """weighed() with score and rank: of the rows with enough words the `percent` hundredths with the highest scores are drawn, the others have no rank."""
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    may = F.col("n_words") >= least_words
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("file"), F.col("at"))
    some = ranked(scored.where(may), "importance-ranked", *order)
    most = F.floor(F.col("total") * percent / F.lit(100))
    return some.withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).select(*scored.columns, "rank").union(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Every row of docs (doc_id, text, file, at): doc_id, file, at, n_words, n_features, weight, score, rank. targets: text."""
    table = written(gains(bucket_counts(docs, buckets, longest), bucket_counts(targets, buckets, longest), buckets), "importance-gains")
    return drawn(weighed(docs, table, buckets, longest), percent, least_words, seed)


def drawn_documents(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with the columns that they have."""
    whole = written(docs.select(whole_row(docs, "doc")), "importance-documents")
    rows = placed(whole.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "doc"), "doc_id", "text", "doc")
    chosen = resampled(rows.drop("doc"), targets, **options).where("rank IS NOT NULL").select(F.col("file").alias("__file"), F.col("at").alias("__at"))
    return rows.join(chosen, (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at"))).select("doc.*")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    found = resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{LOWERED_WORD}')"
#: CRC-32 of each distinct word by its table of 256 entries, which is worked out bit by bit.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT r, unnest(w) AS f FROM d),
b AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
k AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f FROM o UNION SELECT f FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM o JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM o) + {BUCKETS})
                                      / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM b) + {BUCKETS})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM o JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
p AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= (SELECT count(*) FROM x WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS BIGINT) AS rank FROM p
"""
