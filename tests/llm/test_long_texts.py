"""Very long texts, one of them a single line without white space, through every operator and stage: whole, and with the same columns as ever."""

import random
from hashlib import sha256

import corpus_pipeline as pipeline
import pytest
from cases import folder

from thalweg.llm import bpe, decontamination, fim, fm_dedup, importance, line_rules, mixing, mpeg, pii, quality, secrets, simhash, suffix_dedup

R = random.Random(11)
PROSE = " ".join("".join(R.choices("abcdefghijklmnop", k=R.randint(2, 9))) + ("\n" if k % 40 == 39 else "") for k in range(150_000))
TAIL = " mail me@example.org token = abcdefabcdef0123456789abcdef"
FOUND = [(1, PROSE + TAIL), (2, PROSE[: len(PROSE) // 2]), (3, "x" * 300_000), (4, None), (5, "")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("long"), FOUND, [(1, 1, 0), (2, 1, 0), (3, 0, 0)])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_duplicates(spark, sf_dir):
    rows = by_id(suffix_dedup.op1_suffix_dedup(spark, sf_dir))
    shared = len(FOUND[1][1])
    assert [rows[i].n_removed for i in range(1, 6)] == [shared, shared, 300_000, 0, 0]
    rows = by_id(fm_dedup.op6_fm_dedup(spark, sf_dir))
    assert rows[1].n_removed == 0 and rows[2].n_removed >= rows[2].n_words - 1 and rows[3].n_words == 1
    rows = by_id(simhash.op4_simhash(spark, sf_dir))
    assert rows[4].component_id == rows[5].component_id == 4 and rows[1].fingerprint != rows[3].fingerprint


def test_spans(spark, sf_dir):
    rows = by_id(pii.op2_pii(spark, sf_dir))
    assert rows[1].n_email == 1 and f"email:{len(PROSE) + 6}:" in rows[1].spans
    rows = by_id(secrets.op3_secrets(spark, sf_dir))
    assert rows[1].n_assign == rows[1].n_hex == 1 and rows[3].n_hex == 0


def test_tokens_media_and_mixing(spark, sf_dir):
    rows = by_id(bpe.op7_bpe(spark, sf_dir))
    assert all(rows[i].decoded_sha256 == sha256((t or "").encode()).hexdigest() for i, t in FOUND)
    rows = by_id(mpeg.op8_mpeg(spark, sf_dir))
    assert all(rows[i].n_bytes == len((t or "").encode()) for i, t in FOUND) and len(rows[1].seek_offsets) > 500
    rows = by_id(mixing.op5_mixing(spark, sf_dir))
    assert rows[1].size == len(FOUND[0][1].split()) and rows[3].size == 1


def test_quality(spark, sf_dir):
    assert all(0 <= r.score <= 1 for r in quality.op9_quality(spark, sf_dir).collect())
    rows = by_id(line_rules.op10_line_rules(spark, sf_dir))
    assert rows[1].n_words == len(FOUND[0][1].split()) and rows[3].base_failed


def test_near_copies(spark, sf_dir):
    kept = pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 4]


def test_ten_megabytes(spark, tmp_path):
    """The operators on windows, features and cuts, over a text of ten million characters beside its own last part."""
    whole = " ".join("".join(R.choices("abcdefghijklmnop", k=R.randint(2, 9))) + ("\n" if k % 40 == 39 else "") for k in range(1_600_000))
    docs, items = [(1, whole), (2, whole[-500:]), (3, "z" * 10_000_000)], [(7, " ".join(whole.split()[-40:])), (8, " ".join(whole.split()[:300]))]
    sf_dir = folder(spark, tmp_path, docs, items=items)
    rows = by_id(decontamination.op13_decontamination(spark, sf_dir))
    assert len(whole) > 9_000_000 and rows[1].n_items == 2 and rows[2].n_items == 1 and not rows[3].contaminated
    assert rows[1].n_hit == 340 and rows[2].n_hit == 40
    rows = by_id(fim.op12_fim(spark, sf_dir))
    assert all(rows[i].restored_sha256 == sha256(t.encode()).hexdigest() for i, t in docs) and rows[1].n == 40_000
    rows = by_id(importance.op11_importance(spark, sf_dir))
    assert [rows[i].n_features for i in (1, 2, 3)] == [1_600_000, len(whole[-500:].split()), 1]
