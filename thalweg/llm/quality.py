"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gets a vector of statistics (word lengths, character shares, repetition), smoothed and transformed to be
roughly symmetric. From the labelled rows
that train, counts, sums and cross products by class are added up over the partitions; a class's covariance is shrunk towards the pooled one
and towards its own diagonal, factored once by Cholesky, and a text's score is the logistic of the difference of the two log densities,
from Mahalanobis distances by triangular solves, plus that of the log priors.

All labelled rows train that are not held out (crc32 of doc_id as text, mod 5, is 0 for held-out rows); the sums need no sample. Labels, lang,
source and doc_id are no inputs. Null and empty texts have the statistics of an empty text and get a score like any other. A class
without training rows takes the statistics of the other; without any, every score is 0.5. Null doc_ids are not held out and have no labels.
Repeated labels count as often as they are given. Equal texts have equal scores; a score of exactly ACCEPT_AT accepts. Statistics are counts over
a whole text, so very long texts take time in proportion and no more room than the text. Extra columns, whatever their names, are not read, and pass
through `accepted` as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import SLICE, documents, map_rows, small_batches, written

FOLDS = 5
ACCEPT_AT = 0.3
#: Shrinkage towards the pooled covariance, then towards the diagonal; ridge on standardised statistics.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-2

#: Evidence added to each share, so that short texts lie near the middle: bytes, words, lines.
SMOOTH_BYTES, SMOOTH_WORDS, SMOOTH_LINES = 400, 40, 8
TYPICAL_LENGTH, TYPICAL_SHORT = 5.5, 0.35

NAMES = ("word_length", "short_words", "symbols", "pipes", "bangs", "stops", "commas", "capitals", "digits", "other", "repeated_lines", "repeated_triples")
_CLASS = np.zeros((256, 8), np.float64)
for _i, _chars in enumerate((b"#*$%&<>", b"|", b"!", b".", b",;:", bytes(range(65, 91)), b"0123456789")):
    _CLASS[list(_chars), _i] = 1
_CLASS[[b for b in range(33, 128) if not _CLASS[b].any() and not chr(b).isalpha()], 7] = 1
_WHITE = [9, 10, 11, 12, 13, 32]


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw) - int(seen[_WHITE].sum())
    shares = seen @ _CLASS / (size + SMOOTH_BYTES)
    short = sum(len(w) <= 3 for w in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log((size + TYPICAL_LENGTH * SMOOTH_WORDS) / (n + SMOOTH_WORDS)),
        (short + TYPICAL_SHORT * SMOOTH_WORDS) / (n + SMOOTH_WORDS),
        *np.sqrt(shares).tolist(),
        (len(lines) - len(set(lines))) / (len(lines) + SMOOTH_LINES),
        (max(0, n - 2) - len(triples)) / (n + SMOOTH_WORDS),
    ]


def forward_solved(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with low @ x = b for a lower triangular matrix, all columns of b at a time."""
    x = np.empty_like(b)
    for i in range(len(low)):
        x[i] = (b[i] - low[i, :i] @ x[:i]) / low[i, i]
    return x


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and by class: mean, Cholesky factor of the covariance, log determinant and log prior."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows of statistics -> scores from 0 to 1."""
        if not self.means:
            return np.full(len(x), 0.5)
        z = (x - self.center) / self.scale
        density = [c - 0.5 * (forward_solved(f, (z - m).T) ** 2).sum(0) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From count, sums and cross products of each class."""
    d = len(NAMES)
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    by = [moments.get(k, none) for k in (0, 1)]
    n = sum(m[0] for m in by)
    if not n:
        return Discriminant(np.zeros(d), np.ones(d))
    center = sum(m[1] for m in by) / n
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in by)) / n - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def spread(m):
        mean = m[1] / m[0]
        return (mean - center) / scale, (m[2] / m[0] - np.outer(mean, mean)) / np.outer(scale, scale)

    each = [spread(m if m[0] else by[1 - k]) for k, m in enumerate(by)]
    pooled = sum(c * max(1.0, m[0]) for (_, c), m in zip(each, by, strict=True)) / sum(max(1.0, m[0]) for m in by)
    means, factors, constants = [], [], []
    for (mean, own), m in zip(each, by, strict=True):
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(low)
        constants.append(float(np.log((m[0] + 1) / (n + 2)) - np.log(np.diag(low)).sum()))
    return Discriminant(center, scale, tuple(means), tuple(factors), tuple(constants))


def held_out(doc_id):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the column `statistics`."""
    return map_rows(docs, lambda: lambda x: (statistics(x),), "statistics array<double>", text)


def train(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """rows (doc_id, statistics) and labels (doc_id, quality) -> the model. Each partition adds up its moments; d * d numbers a class reach the driver."""
    d = len(NAMES)
    marked = rows.where(~held_out(F.col("doc_id"))).join(labels.select("doc_id", "quality").where("quality IN (0, 1)"), "doc_id").select("quality", "statistics")

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "x"])

    sums = np.zeros(2 * (1 + d + d * d))
    for place, x in marked.mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x")).collect():
        sums[place] = x
    sums = sums.reshape(2, -1)
    return fit({k: (sums[k, 0], sums[k, 1 : 1 + d], sums[k, 1 + d :].reshape(d, d)) for k in (0, 1) if sums[k, 0]})


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """rows with `statistics` -> with score instead."""
    columns = [c for c in rows.columns if c != "statistics"]
    at = rows.columns.index("statistics")

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(model.score(x))], [*columns, "score"])

    return rows.mapInArrow(run, rows.select(*columns).schema.add("score", "double"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns as they were.

    The statistics are written before the sums: where labels are broadcast both would run in one task, each with a Python worker, and workers
    that are taken in turn never end: later stages would fill twice as many of them.
    """
    model = train(written(with_statistics(docs.select("doc_id", text), text), "quality-statistics"), labels)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                scores = model.score(np.array([statistics(x or "") for x in part.column(at).to_pylist()]))
                yield part.filter(pa.array(scores >= ACCEPT_AT))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(with_statistics(documents(spark, sf_dir, "doc_id", "text")), "quality-statistics")
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    df = scored(rows, model)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT_AT).cast("int").alias("predicted"))
