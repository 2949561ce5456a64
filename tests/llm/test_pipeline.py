"""Each stage of the pipeline on its own input, against plain Python."""

from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from cases import folder, rows
from test_near_copies import expected

from thalweg.llm import bpe, pii, quality

LABELS = [(i, i % 2, 0) for i in range(3, 26)]


@pytest.fixture
def docs(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, rows(), LABELS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir


def whole(df):
    return Counter(map(tuple, df.collect()))


def test_quality(spark, docs):
    df, sf_dir = docs
    out = pipeline.accept_quality(spark, df, sf_dir)
    model = quality.train(quality.with_statistics(df.select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stays = [r for r in df.collect() if model.score(np.array([quality.statistics(r.text or "")]))[0] >= 0.3]
    assert out.columns == df.columns and whole(out) == Counter(map(tuple, stays))


def test_quality_takes_one_python_worker_a_task(spark, docs, monkeypatch):
    """The sums read written statistics: they are no second Python step behind the first one in the same task."""
    df, sf_dir = docs
    given, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows, labels: given.append(rows) or train(rows, labels))
    pipeline.accept_quality(spark, df, sf_dir)
    plans = [rows._jdf.queryExecution().toString() for rows in given]
    assert len(plans) == 1 and "MapInArrow" not in plans[0] and "MapInArrow" in quality.with_statistics(df)._jdf.queryExecution().toString()


def test_near_copies(spark, docs):
    df, sf_dir = docs
    out = pipeline.drop_near_copies(spark, df, sf_dir)
    assert out.columns == df.columns and not whole(out) - whole(df)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(expected([(r.doc_id, r.text) for r in df.collect()])[0], key=repr)


def test_personal_data(spark, docs):
    df, sf_dir = docs
    df = df.unionByName(spark.createDataFrame([(70, "write to a@b.org or +1 555 010 9999", "en", "a", 36, "k", 1, 0.5, "i")], df.schema))
    out = pipeline.redact_personal_data(spark, df, sf_dir)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("doc_id = 70").first()[:5] == (70, "write to [EMAIL] or [PHONE]", "en", "a", 27)
    assert Counter(r.text for r in out.collect()) == Counter(None if r.text is None else pii.redact(r.text) for r in df.collect())


def test_tokens(spark, docs):
    df, sf_dir = docs
    out = pipeline.encode_tokens(spark, df, sf_dir)
    own = bpe.load(bpe.vocabulary())
    decoded = Counter(own.decode(np.array(r.ids, "<u4").tobytes()).decode() for r in out.collect())
    assert decoded == Counter(r.text or "" for r in df.collect())


def test_run(spark, docs, tmp_path):
    _, sf_dir = docs
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("n_tokens <> size(ids)").count() == 0
    empty = folder(spark, tmp_path / "empty", [])
    assert pipeline.run(spark, empty).count() == 0


def test_stages():
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mixing", "tokens"] and pipeline.ORACLE_SQL is None
