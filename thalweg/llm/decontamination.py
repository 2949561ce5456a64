"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are compared with ASCII letters lowered. A window is WINDOW consecutive words of a benchmark item, or a whole item of fewer. Windows of one
length are found by winnowing: each run of `gram` words is hashed, and of every window's runs the least hash is kept. A text that shares a window
with an item shares its least hash too, so no shared span of WINDOW words or more is lost. For items of fewer words than WINDOW the run is the item's
whole length, by the same steps; there are at most WINDOW - 1 such lengths.

1. A text's fingerprints are its kept hashes, each with the run of windows that keep it; they are joined with those of items. A bit table of fixed
   size (common.bit_table) leaves out nearly all others first, so that only few rows are shuffled; texts stay where they are.
2. Hits are extended: only documents with hits are read again, and each window of a run that hit is compared, word by word, with the distinct windows
   of the items. A place in a document equals at most one of these, so that no passage, however common on either side, multiplies rows.
3. Hit words are those in any occurrence: the occurrences' places of a document are united in one pass.
4. Items come in by classes: windows that occur in the same items are one class, documents with the same classes have one set of items, worked out once.

Null and empty texts have no words: as documents they are clean, as items they have no window. Repeated rows, also of a doc_id, are judged each for
itself; rows of one item_id are one item with the windows of all; a null item_id stands for the word null. An empty table of documents gives an empty
result, one of items leaves all clean. Of texts of any length every window counts. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import CAPITALS, LOWERED_WORD, ascii_lower, ascii_words, bit_table, bound, documents, maybe, placed, written

#: Words of a window, and of the runs that are hashed: longer runs hit less by chance, shorter ones keep fewer hashes.
WINDOW, GRAM = 10, 7


def _starts(n: Column, width: Column) -> Column:
    """1, 2, ... of all runs of `width` among n."""
    return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))


def lowered(text: Column | str) -> Column:
    return F.transform(ascii_words(text), ascii_lower)


def winnowed(words: Column, window: int, gram: int) -> Column:
    """Of each window of a text's words, in order, the least hash of its runs of `gram` words. words: array of lowered words."""
    least = F.lit(window - gram + 1)

    def runs(h: Column) -> Column:
        return F.transform(_starts(F.size(h), F.lit(gram)), lambda i: F.xxhash64(F.slice(h, i, F.lit(gram))))

    def minima(g: Column) -> Column:
        return F.transform(_starts(F.size(g), least), lambda i: F.array_min(F.slice(g, i, least)))

    return bound(bound(F.transform(words, lambda w: F.xxhash64(w)), runs), minima)


def gram_of(length: int, window: int, gram: int) -> int:
    """Words of the hashed runs for windows of a length."""
    return gram if length == window else length


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, length, content (lowered words joined by a space): the distinct windows of each item. items: item_id, text."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    words = items.select(item, lowered("text").alias("w")).where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    each = F.transform(_starts(F.size("w"), F.col("length")), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))
    return words.select("item", "length", F.explode(each).alias("content")).distinct()


def classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, length, class; class, item): windows in the same items are one class, named by its items' digest."""
    sets = found.groupBy("content", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = written(sets.withColumn("class", F.md5(F.to_json("items"))), "leaks-windows")
    return sets.select("content", "length", "class"), written(sets.groupBy("class").agg(F.first("items").alias("items")).select("class", F.explode("items").alias("item")), "leaks-classes")


def fingerprints(least: Column) -> Column:
    """array<struct<low, high, hash>>: runs of windows (numbered from 0, both ends included) that keep the same hash. least: winnowed()."""
    heads = F.filter(_starts(F.size(least), F.lit(1)), lambda k: (k == 1) | (F.get(least, k - 1) != F.get(least, k - 2)))

    def runs(at: Column) -> Column:
        return F.transform(at, lambda k, i: F.struct((k - 1).alias("low"), (F.coalesce(F.get(at, i + 1), F.size(least) + 1) - 2).alias("high"), F.get(least, k - 1).alias("hash")))

    return bound(heads, runs)


def occurrences(docs: DataFrame, distinct: DataFrame, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """file, at, start, length, class: where windows of items occur, start counting words from 0. docs: text, file, at; distinct: content, length, class."""
    kinds = [(n, gram_of(n, window, gram)) for n in lengths]
    known = [distinct.where(F.col("length") == n).select(F.lit(n).alias("kind"), F.explode(winnowed(F.split("content", " "), n, g)).alias("hash")) for n, g in kinds]
    known = written(reduce(DataFrame.union, known).distinct(), "leaks-hashes")
    each = [docs.select("file", "at", F.lit(n).alias("kind"), F.inline(bound(winnowed(lowered("text"), n, g), fingerprints))) for n, g in kinds]
    likely = maybe(reduce(DataFrame.union, each), bit_table(known, "kind", "hash"), "kind", "hash").where("held")
    named = known.select(F.col("kind").alias("__kind"), F.col("hash").alias("__hash"))
    hits = likely.join(named, (F.col("kind") == F.col("__kind")) & (F.col("hash") == F.col("__hash")), "left_semi")
    own = hits.groupBy(F.col("file").alias("__file"), F.col("at").alias("__at")).agg(F.collect_list(F.struct("kind", "low", "high")).alias("hits"))
    own = written(own, "leaks-hits")

    some = maybe(docs, bit_table(own, "__file", "__at"), "file", "at").where("held")
    some = some.join(own, (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at"))).select("file", "at", lowered("text").alias("w"), "hits")

    def compared(w: Column) -> Column:
        def of(x: Column) -> Column:
            return F.transform(F.sequence(x["low"], x["high"]), lambda i: F.struct(i.alias("start"), x["kind"].alias("size"), F.array_join(F.slice(w, i + 1, x["kind"]), " ").alias("text")))

        return F.flatten(F.transform("hits", of))

    places = some.select("file", "at", F.inline(bound(F.col("w"), compared)))
    same = (F.col("text") == F.col("content")) & (F.col("size") == F.col("length"))
    return places.join(distinct, same).select("file", "at", "start", "length", "class")


def united(starts: Column, ends: Column) -> Column:
    """Sorted starts and sorted ends of spans -> array<struct<start, end>> of the maximal runs that they cover.

    With both in order, a run ends at the k-th end exactly if the next start, the k+1-th, lies beyond it; so nothing is carried from one to the next.
    """

    def runs(a: Column) -> Column:
        n = F.size(a["s"])
        last = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | (F.get(a["s"], k) > F.get(a["e"], k - 1)))
        return bound(last, lambda x: F.transform(x, lambda k, i: F.struct(F.get(a["s"], F.when(i == 0, F.lit(0)).otherwise(F.get(x, i - 1))).alias("start"), F.get(a["e"], k - 1).alias("end"))))

    return bound(F.struct(starts.alias("s"), ends.alias("e")), runs)


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(file, at, spans, sources; sources, items): of each document with hits the maximal runs of hit words (start, end exclusive) and the name of its
    set of items; and of each such set its items in order. docs: text, file, at (common.placed); items: item_id, text."""
    distinct, members = classes(windows(items, window))
    # At most `window` lengths.
    lengths = sorted(r[0] for r in distinct.select("length").distinct().collect()) or [window]
    found = occurrences(docs, distinct, lengths, window, gram)
    starts, ends = (F.sort_array(F.collect_list(c)) for c in (F.col("start"), F.col("start") + F.col("length")))
    mine = found.groupBy("file", "at").agg(starts.alias("starts"), ends.alias("ends"), F.sort_array(F.collect_set("class")).alias("classes"))
    mine = written(mine.select("file", "at", united(F.col("starts"), F.col("ends")).alias("spans"), "classes", F.md5(F.array_join("classes", ",")).alias("sources")), "leaks-documents")
    sets = mine.groupBy("sources").agg(F.first("classes").alias("classes")).select("sources", F.explode("classes").alias("__class"))
    sets = sets.join(members, F.col("__class") == F.col("class")).groupBy("sources").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return mine.select("file", "at", "spans", "sources"), sets


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, file, at) -> doc_id, n_words, n_hit, spans, items, contaminated for every row."""
    found, sets = leaks(docs, items, window, gram)
    found = found.join(sets.withColumnRenamed("sources", "__sources"), F.col("sources") == F.col("__sources")).select(F.col("file").alias("__file"), F.col("at").alias("__at"), "spans", "items")
    each = docs.select("doc_id", "file", "at", F.size(ascii_words("text")).cast("long").alias("n_words"))
    each = each.join(found, (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at")), "left")
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return each.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    df = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{LOWERED_WORD}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS x
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0)),
o AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
f AS (SELECT r, s, n, item FROM o JOIN i USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM f)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""
