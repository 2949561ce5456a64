"""The quality discriminant, and the line rules with their field."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from cases import folder, ordered, outcome, rows

from thalweg.llm import line_rules, quality

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def accuracy(spark, df, column):
    """Balanced, on held-out labelled documents."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    hits = {0: [], 1: []}
    for r in df.collect():
        if held_out(r.doc_id) and r.doc_id in labels:
            hits[labels[r.doc_id]].append(int(r[column]) == labels[r.doc_id])
    return min(np.mean(x) for x in hits.values())


def test_held_out_quality(spark):
    df = quality.op9_quality(spark, SF).cache()
    assert df.where("held_out").count() == sum(held_out(r.doc_id) for r in df.collect())
    assert df.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.3)").count() == 0
    assert accuracy(spark, df, "predicted") >= 0.8


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    found = [(i, t) for i, t in rows() if i is not None]
    labels = [(i, i % 2, 0) for i in {i for i, _ in found}]
    a = quality.op9_quality(spark, folder(spark, tmp_path / "a", found, labels))
    b = quality.op9_quality(spark, folder(spark, tmp_path / "b", found, [(i, 1 - q if held_out(i) else q, 1) for i, q, _ in labels]))
    assert outcome(a, "doc_id", "held_out", "score", "predicted") == outcome(b, "doc_id", "held_out", "score", "predicted")


def test_score_is_the_difference_of_densities():
    r = np.random.default_rng(2)
    d = len(quality.NAMES)
    x = {k: r.normal(k, 1 + k, (80 + 40 * k, d)) for k in (0, 1)}
    model = quality.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    every = np.concatenate([x[0], x[1]])
    z = {k: (v - every.mean(0)) / every.std(0) for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = (cov[0] * 80 + cov[1] * 120) / 200
    log = []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + quality.RIDGE * np.eye(d)
        away = (every - every.mean(0)) / every.std(0) - z[k].mean(0)
        log.append(np.log((len(x[k]) + 1) / 202) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(log[0] - log[1])))


@pytest.mark.parametrize("labels", [[], [(5, 1, 0)]])
def test_little_to_learn_from(spark, tmp_path, labels):
    sf_dir = folder(spark, tmp_path, rows(), labels)
    assert quality.op9_quality(spark, sf_dir).where("score BETWEEN 0 AND 1").count() == len(rows())
    assert line_rules.op10_line_rules(spark, sf_dir).where("kept IS NOT NULL").count() == len(rows())


def test_empty_tables(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [])
    assert quality.op9_quality(spark, sf_dir).count() == line_rules.op10_line_rules(spark, sf_dir).count() == 0


def base_rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    repeated = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_base_rules(spark, sf, tmp_path):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for found, sf_dir in ((rows(), folder(spark, tmp_path, rows())), (whole, sf)):
        df = line_rules.op10_line_rules(spark, sf_dir)
        assert outcome(df, *columns) == ordered((i, *base_rules(t)) for i, t in found)
        assert df.where("base_failed AND kept").count() == 0


def test_held_out_verdicts(spark):
    assert accuracy(spark, line_rules.op10_line_rules(spark, SF), "kept") >= 0.7


def test_decoding_is_the_best_of_all_labellings():
    r = np.random.default_rng(4)
    for n in range(1, 9):
        field = line_rules.Field(r.normal(size=len(line_rules.FEATURES)), r.normal(size=(2, 2)))
        x = r.normal(size=(n, len(line_rules.FEATURES)))

        def score(labels, field=field, x=x):
            return sum(x[i] @ field.weights for i, y in enumerate(labels) if y) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

        assert tuple(field.decode(x.tolist())) == max(product((0, 1), repeat=n), key=score)


def test_gradient_of_the_likelihood():
    r = np.random.default_rng(5)
    d = len(line_rules.FEATURES)
    sequences = [(r.normal(size=(n, d)), r.integers(0, 2, n)) for n in (1, 3, 4)]
    theta = r.normal(size=d + 4)

    def likelihood(t):
        total = 0.0
        for x, y in sequences:
            def score(labels, x=x):
                return sum(x[i] @ t[:d] for i, v in enumerate(labels) if v) + sum(t[d + 2 * a + b] for a, b in zip(labels, labels[1:], strict=False))

            total += score(y) - np.log(sum(np.exp(score(labels)) for labels in product((0, 1), repeat=len(y))))
        return total

    exact = line_rules._gradient(theta, *line_rules._padded(sequences))
    for k in range(d + 4):
        step = np.zeros(d + 4)
        step[k] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - exact[k]) < 1e-4
