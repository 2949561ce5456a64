"""Quality rules with line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

A text's lines that hold a word form a sequence. Every line has a vector of features (shares of symbols, capitals, digits, table bars, repeats,
closing punctuation, licence words); the field scores a line's label by the features and two neighbouring labels by a transition matrix, and
Viterbi decoding gives the best labelling of the whole text. The share of words on content lines decides whether a document stays, after two
base rules (at least LEAST_WORDS words, and at most half of the words in repeated three-word windows).

Weights are trained here, by gradient ascent on the exact conditional likelihood (forward-backward), over a bounded sample: SAMPLE documents of
either quality among the labelled ones (crc32 of doc_id mod 5 not 0), the first by hash of doc_id, and at most LINES lines of each. A line takes its
document's label unless the START weights speak clearly against it, and licence lines are boilerplate in either, so that labels change within
documents and transitions are learned. Without labels of both kinds, the START weights decode.

Null and empty texts have no words and fail the base. Equal texts give equal rows; ties in decoding go to content. Texts are labelled whole,
in time in proportion to their length. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import documents, map_rows
from thalweg.llm.quality import held_out

LEAST_WORDS = 50
CONTENT_SHARE = 0.4
#: Documents of either quality in the training sample, and lines of each that it takes.
SAMPLE, LINES = 600, 400
STEPS, RATE, BATCH = 80, 0.15, 64
#: Quadratic penalties on feature weights and on transitions; the latter keeps one line from deciding for a whole text.
PENALTY, PENALTY_MOVES = 1e-3, 0.05

FEATURES = ("bias", "length", "symbols", "bars", "bangs", "capitals", "digits", "closed", "short_words", "repeated_line", "repeated_words", "licence")
#: Weights for content before any training, and the score of staying on a label.
START = (1.0, 0.5, -8.0, -4.0, -4.0, -3.0, -2.0, 0.5, 0.5, -2.0, -2.0, -4.0)
STAY = 0.5
#: A line's score by START beyond which it does not take its document's label in training.
CLEAR = 1.6
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&<>|", bytes(range(65, 91)), b"0123456789"
_LICENCE = (b"licen", b"rights reserved", b"copyright", b"cookie", b"privacy policy", b"terms of use")


def _lacks(line: bytes, chars: bytes) -> int:
    return len(line) - len(line.translate(None, chars))


def line_features(raw: bytes) -> tuple[list[list[float]], list[int]]:
    """Of the lines that hold a word: features in the order of FEATURES, and numbers of words."""
    lines = [(line, words) for line in raw.split(b"\n") if (words := line.split())]
    times = Counter(line for line, _ in lines)
    rows, sizes = [], []
    for line, words in lines:
        n = len(words)
        size = len(line) - _lacks(line, _SPACE)
        low = line.lower()
        rows.append([
            1.0, min(1.0, n / 20), min(1.0, 4 * _lacks(line, _SYMBOLS) / size), min(1.0, 2 * line.count(b"|") / n), min(1.0, 2 * line.count(b"!") / n), min(1.0, 2 * _lacks(line, _CAPITALS) / size),
            _lacks(line, _DIGITS) / size, float(words[-1][-1:] in b".!?"), sum(len(w) <= 3 for w in words) / n, float(times[line] > 1), 1 - len(set(words)) / n, float(any(x in low for x in _LICENCE)),
        ])
        sizes.append(n)
    return rows, sizes


@dataclass(frozen=True)
class Field:
    """Weights of label 1 (content) against 0 (boilerplate), and transition scores [from][to]."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, rows: list[list[float]]) -> list[int]:
        """The best labels of one sequence."""
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        scores = (np.array(rows) @ self.weights).tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = a + m01 > b + m11, a + m00 > b + m10
            back.append((0 if from1 else 1, 0 if from0 else 1))
            a, b = (a + m00 if from1 else b + m10), (a + m01 if from0 else b + m11) + s
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """sequences of (features, labels) -> the field of the greatest penalised likelihood that STEPS of Adam reach."""
    if not sequences:
        return Field(np.array(START), np.array([[STAY, 0.0], [0.0, STAY]]))
    d = len(FEATURES)
    ordered = sorted(sequences, key=lambda s: len(s[1]))
    batches = [_padded(ordered[i : i + BATCH]) for i in range(0, len(ordered), BATCH)]
    total = sum(len(y) for _, y in sequences)
    theta = np.concatenate([START, [STAY, 0.0, 0.0, STAY]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    penalty = np.array([PENALTY] * d + [PENALTY_MOVES] * 4)
    for step in range(1, STEPS + 1):
        gradient = sum(_gradient(theta, *batch) for batch in batches) / total - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:d], theta[d:].reshape(2, 2))


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, most = len(sequences), max(len(y) for _, y in sequences)
    x, y, on = np.zeros((n, most, len(FEATURES))), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (rows, labels) in enumerate(sequences):
        x[i, : len(labels)], y[i, : len(labels)], on[i, : len(labels)] = rows, labels, True
    return x, y, on


def _gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Features and transitions seen, less those expected: the gradient of the log likelihood of a padded batch."""
    (n, most, d), pair_on = x.shape, on[:, 1:]
    moves = theta[d:].reshape(2, 2)
    emit = np.zeros((n, most, 2))
    emit[:, :, 1] = x @ theta[:d]
    forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, most):
        new = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + emit[:, t]
        forward[:, t] = np.where(on[:, t, None], new, forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        ahead = emit[:, t + 1] + backward[:, t + 1]
        new = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        backward[:, t] = np.where(on[:, t + 1, None], new, 0.0)
    norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    marginal = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm[:, None]) * on
    joint = forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - norm[:, None, None, None]
    expected = (np.exp(np.minimum(joint, 0)) * pair_on[:, :, None, None]).sum((0, 1)).ravel()
    seen = np.array([((y[:, :-1] == a) & (y[:, 1:] == b) & pair_on).sum() for a in (0, 1) for b in (0, 1)])
    return np.concatenate([np.einsum("nt,ntd->d", ((y == 1) & on) - marginal, x), seen - expected])


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: at most SAMPLE documents of either quality, the first by hash of doc_id."""
    rows = labels.where("quality IN (0, 1)").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = rows.where("quality = 0").orderBy(*order).limit(SAMPLE).union(rows.where("quality = 1").orderBy(*order).limit(SAMPLE)).select(F.col("doc_id").alias("__id"), "quality")
    picked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # 2 * SAMPLE rows of two numbers
    found = map_rows(picked, lambda: lambda x: (line_features(x.encode())[0][:LINES],), "rows array<array<double>>").orderBy("doc_id", "quality").select("quality", "doc_id", "rows").collect()
    out = []
    licence = FEATURES.index("licence")
    for quality, _, lines in found:
        if lines:
            x = np.array(lines)
            plain = x @ np.array(START)
            out.append((x, (np.where(np.abs(plain) > CLEAR, plain > 0, quality == 1) & (x[:, licence] == 0)).astype(int)))
    return out if len({int(q) for q, _, lines in found if lines}) == 2 else []


def rules(text: str, field: Field) -> tuple:
    """What the contract asks of one whole text, and the share of words on content lines."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(grams)) < len(grams):
        times, covered = Counter(grams), bytearray(n)
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeat = sum(covered)
    lines = [x for x in raw.split(b"\n") if x.split()]
    rows, sizes = line_features(raw)
    content = sum(s for s, label in zip(sizes, field.decode(rows), strict=True) if label)
    share = content / n if n else 0.0
    failed = n < LEAST_WORDS or 100 * repeat > 50 * n
    return n, len(text) - _lacks(raw, _SPACE), _lacks(raw, b"#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed, not failed and share >= CONTENT_SHARE, share


def judged(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs without its text, with the rules' counts and verdicts."""
    return map_rows(docs, lambda: lambda x: rules(x, field), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double", text)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return judged(docs, train(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
