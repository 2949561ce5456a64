"""A corpus pipeline on the operators of thalweg.llm: accept by quality, keep one of near copies, redact personal data, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
keep the columns of documents, whatever they are; nulls, empty texts, repeated rows and empty tables go through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm import bpe, mixing, near_copies, pii, quality
from thalweg.llm.common import written

#: Near copies: sets of five-word shingles whose Jaccard similarity is 0.8 or more, compared exactly; and the bits in which fingerprints of texts
#: differ at most that are compared first.
SHINGLE_WORDS, SIMILARITY, NEAR_BITS = 5, 0.8, 6


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return near_copies.one_of_each(docs, SHINGLE_WORDS, SIMILARITY, NEAR_BITS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept, cut at a budget's end or left out, so that each source comes to its target."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; decoding must give the text back."""
    return bpe.tokenized(docs)


STAGES = [
    ("quality", accept_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL can express neither the classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
