"""Small tables with awkward rows, and how to run a query over them."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, taken double, ids string"
LABELS = "doc_id long, quality int, toxic int"


def texts():
    r = random.Random(7)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))

    passage, other, body = words(150), words(95), words(60)
    copy = f"{words(30)} {passage} {words(20)}"
    near = body.split()
    near[31] = "changed"
    return [
        None, "", " \n\t ", "word", "Word", body, " ".join(near), body.upper(), passage, copy, copy, copy, f"{words(10)}\n{passage}\n{words(5)}\n{passage}", "ab" * 700, "ab" * 500 + "c", "x y z " * 90,
        f"é{passage[1:]} ü {other}", f"{other} {words(8)}", words(6000), f"{other[:-9]}\n{other[:-9]}", "line one here\nline one here\nline one here", "​   \U0001f600 İ",
    ]


def rows():
    """(doc_id, text): also repeated ids, repeated rows and null ids."""
    found = list(enumerate(texts(), 3))
    passage = texts()[8]
    return [*found, (None, passage), (None, None), (4, passage + " tail"), (9, texts()[6]), (9, texts()[6]), (1, passage.upper())]


def folder(spark, tmp_path, found, labels=(), items=()):
    """A table folder of those (doc_id, text), with columns whose names operators use themselves; also labels and (item_id, text) of a benchmark."""
    sources = ("a", "b", None, "a", "a")
    spark.createDataFrame([(i, t, None, sources[k % 5], None if t is None else len(t), "k", k, 0.5, "i") for k, (i, t) in enumerate(found)], DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def outcome(df, *columns):
    return ordered(tuple(r[c] for c in columns) for r in df.collect())


def ordered(found):
    return sorted(found, key=repr)
