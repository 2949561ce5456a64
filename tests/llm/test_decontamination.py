"""Decontamination against plain Python over all windows."""

import random
import re
from hashlib import sha256

import pytest
from cases import folder, ordered, outcome, rows, texts
from pyspark.sql import functions as F

from thalweg.llm import common, decontamination

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, window=10):
    where = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            where.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    sizes = sorted({len(k) for k in where})
    found = []
    for i, text in docs:
        w = words(text)
        hit, own = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in where:
                    hit.update(range(a, a + n))
                    own |= where[key]
        found.append((i, len(w), len(hit), len(own), sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return ordered(found)


def items():
    t = texts()
    body, passage = t[5], t[8]
    some = passage.split()
    return [
        (1, body), (2, " ".join(some[40:75])), (10, " ".join(some[40:50])), (11, " ".join(some[41:50])), (3, None), (4, ""), (5, "..."), (6, "X y"), (7, "word"), (None, " ".join(some[100:110])),
        (2, "é unrelated words of nine only here for now ü"), (8, " ".join(some[70:75] + ["else"] * 8)), (9, "line one here line ONE, here. Line one-here x"), (12, body.upper()), (13, "aaa " * 40),
    ]


def test_query(spark, sf, tmp_path):
    passage = texts()[8].split()
    more = [(200, " ".join(passage[40:49])), (201, " ".join(passage[40:50])), (202, "aaa " * 25), (203, "aaa " * 9), (204, " ".join(passage[41:50])), (205, "x-Y!"), *[(206, texts()[8])] * 20]
    docs = [*rows(), *more]
    assert outcome(decontamination.op13_decontamination(spark, folder(spark, tmp_path, docs, items=items())), *COLUMNS) == expected(docs, items())
    whole, own = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = decontamination.op13_decontamination(spark, sf)
    assert outcome(found, *COLUMNS) == expected(whole, own)
    assert not [x for x in found._jdf.queryExecution().toString().split() if "Python" in x or "Arrow" in x]


def test_empty_tables(spark, tmp_path):
    assert decontamination.op13_decontamination(spark, folder(spark, tmp_path / "none", [], items=items())).count() == 0
    assert outcome(decontamination.op13_decontamination(spark, folder(spark, tmp_path / "clean", rows())), *COLUMNS) == expected(rows(), [])
    nothing = [(1, None), (2, " - ")]
    assert outcome(decontamination.op13_decontamination(spark, folder(spark, tmp_path / "blank", rows(), items=nothing)), *COLUMNS) == expected(rows(), [])


@pytest.mark.parametrize("window, gram", [(10, 7), (10, 10), (6, 2), (4, 1)])
def test_every_window_is_found(spark, tmp_path, window, gram):
    """Words of few kinds, so that hashes, runs and windows repeat: nothing is lost for any lengths of windows and runs."""
    r = random.Random(window * gram)
    some = lambda n: " ".join(r.choices("abc", k=n))
    docs, own = [(k, some(r.randint(0, 60))) for k in range(60)], [(k, some(r.randint(0, 40))) for k in range(6)]
    sf_dir = folder(spark, tmp_path, docs, items=own)
    table = common.placed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = decontamination.contaminated(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window, gram)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    assert outcome(found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), digest, "contaminated"), *COLUMNS) == expected(docs, own, window)


def test_spans(spark, tmp_path):
    passage = texts()[8].split()
    docs = [(1, "before it " + " ".join(passage[40:60]) + " between " + " ".join(passage[40:50]) + " after")]
    sf_dir = folder(spark, tmp_path, docs, items=[(2, " ".join(passage[40:55]))])
    table = common.placed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = decontamination.contaminated(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).first()
    assert [tuple(x) for x in found["spans"]] == [(2, 17), (23, 33)] and found["items"] == ["2"]
