"""Importance resampling against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from cases import folder, ordered, outcome, rows
from pyspark.sql import functions as F

from thalweg.llm import common, importance

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")
ITEMS = [(1, "word abc x y z"), (2, None), (2, "X Y Z"), (None, "é Ü word")]


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(docs, items, buckets=10000, longest=1, percent=10, least=20, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in table for f in features(x, longest)) for table in (docs, items))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    found = []
    for i, x in docs:
        fs = features(x, longest)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(fs), weight, score, None, len(words(x))])
    may = sorted((r for r in found if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = k
    return ordered(tuple(r[:5]) for r in found)


def test_query(spark, sf, tmp_path):
    docs = [*rows(), *((100 + k, f"{'word ' * k} abc") for k in range(90)), *[(500, "x y z " * 9)] * 30]
    sf_dir = folder(spark, tmp_path, docs, items=ITEMS)
    assert outcome(importance.op11_importance(spark, sf_dir), *COLUMNS) == expected(docs, ITEMS)
    whole, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert outcome(importance.op11_importance(spark, sf), *COLUMNS) == expected(whole, items)


@pytest.mark.parametrize("longest, percent, buckets", [(2, 50, 97), (3, 100, 10)])
def test_longer_runs_and_other_options(spark, tmp_path, longest, percent, buckets):
    docs = rows()
    sf_dir = folder(spark, tmp_path, docs, items=ITEMS)
    table = common.placed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = importance.resampled(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), buckets, longest, percent, 5, "s")
    assert outcome(found, *COLUMNS) == expected(docs, ITEMS, buckets, longest, percent, 5, "s")


def test_empty_tables(spark, tmp_path):
    assert importance.op11_importance(spark, folder(spark, tmp_path / "none", [], items=ITEMS)).count() == 0
    docs = rows()
    assert outcome(importance.op11_importance(spark, folder(spark, tmp_path / "no items", docs)), *COLUMNS) == expected(docs, [])


def test_drawn_rows_keep_their_columns(spark, tmp_path):
    docs = [*rows(), *((100 + k, "word " * (k + 20)) for k in range(30))]
    sf_dir = folder(spark, tmp_path, docs, items=ITEMS)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("file", F.lit("f")).withColumn("at", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("rank", F.lit("r"))
    found = importance.drawn_documents(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert found.columns == table.columns and found.where("`rank` <> 'r' OR file <> 'f'").isEmpty()
    drawn = [r for r in expected(docs, ITEMS) if r[4]]
    assert outcome(found, "doc_id") == ordered((r[0],) for r in drawn) and drawn


def test_places_across_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    found = {r.id: (r.place, r.total) for r in common.ranked(df, "places", F.col("a").desc(), F.col("id")).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [found[i] for i in want] == [(k, 1000) for k in range(1, 1001)]
