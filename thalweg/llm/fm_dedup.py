"""Substring deduplication of words by compressed full-text indexes.

Every word goes that is covered by a window of WIDTH words whose sequence also starts in a document with a smaller doc_id; windows are judged on
the input. Stretches of text that may hold such windows (see repeats) meet in shards. A shard's stretches are indexed: their words are numbered,
the suffixes sorted, and the transform that puts the word before each suffix in the suffixes' order is held in a wavelet matrix of packed bits
with block counts; the order itself is not kept, only whose suffix stands where, as a rank of its doc_id, and how many words neighbours share.

Then the stretches are streamed through the index from right to left, many at a time. For each place of a stretch this gives its matching
statistic: the length of the longest string from there that a stretch with a smaller doc_id holds too. Interval and length go on from word to word.
A word is put before the match by one backward step; where the interval that it leads to is empty, or holds no smaller doc_id, the match loses words at
its right end until the interval widens, and the step is tried again. Places whose statistic reaches WIDTH are reported with the smallest
doc_id of their interval.

A null doc_id comes after all others; two null ones are not before each other. Rows with one doc_id do not count against each other. Null and
empty texts have no words (and keep the digest of an empty string). Words are as in the text, joined by one space when kept. Very long texts are
read whole; only their stretches are shuffled, each to its shard. An empty table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.common import documents
from thalweg.llm.repeats import LAST, Units, covered, marked_windows, scramble, search, with_verdicts
from thalweg.llm.repeats import _chunks as chunks
from thalweg.llm.repeats import _texts as texts
from thalweg.llm.suffix_dedup import suffix_order

WIDTH, GRAM, STEP = 13, 7, 2


class Words(Units):
    """A text as words."""

    width, gram, unit_bytes, least_bytes, reach, range_sizes = WIDTH, GRAM, 7, 2 * WIDTH - 1, WIDTH, (1,)

    def read(self, text):
        return text.encode().split()

    def codes(self, units):
        return scramble(np.fromiter(map(xxhash.xxh64_intdigest, units), np.uint64, len(units)))

    def content(self, units, start, end):
        return b" ".join(units[start:end])

    def split(self, content):
        return content.split()


class Bits:
    """A bit array packed into words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Minima:
    """Minima of ranges of an array, by those of runs of doubling length."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 ** len(self.tables) <= len(values):
            half = 2 ** (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each non-empty range."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.tables[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][lo[at]], self.tables[k][hi[at] - 2**k])
        return out

    def smaller_left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to `at` whose value is below the bound; there is one."""
        for k in range(len(self.tables) - 1, -1, -1):
            start = at - 2**k + 1
            at = np.where((start >= 0) & (self.tables[k][np.maximum(start, 0)] >= bound), start - 1, at)
        return at

    def smaller_right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose value is below the bound; there is one."""
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            at = np.where((at < len(table)) & (table[np.minimum(at, len(table) - 1)] >= bound), at + 2**k, at)
        return at


class Index:
    """The full-text index of a sequence of numbers below `top`: counts of smaller symbols, a wavelet matrix of the transform, for each place in
    the order of suffixes the value of the sequence's member that starts it, and how many symbols it shares with the place before.

    The symbol 0 ends the sequence and parts it; nothing that is searched holds it.
    """

    def __init__(self, s: np.ndarray, top: int, values: np.ndarray):
        order = suffix_order(s)
        self.size = len(s)
        self.values = Minima(values[order])
        self.shared = Minima(shared_starts(s, order))
        transform = s[order - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top))])
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bits = (transform >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits)))
            transform = np.concatenate([transform[~bits], transform[bits]])
        # Where a symbol's places begin, less where its path begins at the bottom of the matrix.
        self.begin = self.smaller[:-1] - self.descend(np.arange(top), np.zeros(top, np.int64))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i of the transform comes to at the bottom of the matrix, on the path of symbol c."""
        for shift, bits in self.levels:
            ones = bits.ones(i)
            i = np.where(c >> shift & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def extended(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what was matched with the symbols c before it: one backward step."""
        begin, both = self.begin[c], self.descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return begin + both[: len(c)], begin + both[len(c) :]

    def shortened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches cut at their right end until their intervals widen, which are shorter than all suffixes: intervals and lengths."""
        length = np.maximum(self.shared.tables[0][lo], self.shared.tables[0][hi]).astype(np.int64)
        # What is shared by no neighbour is the empty match.
        wide = np.maximum(length, 1)
        left, right = self.shared.smaller_left(lo, wide), self.shared.smaller_right(hi, wide)
        return np.where(length > 0, left, 0), np.where(length > 0, right, self.size), length

    def statistics(self, s: np.ndarray, start: np.ndarray, end: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the places start to end of s (a row each, streamed side by side from the right): place, length of the longest
        string from there, within the row, whose interval holds a value under `below`, and the least value in it. Only places with a match are given."""
        n = len(start)
        lo, hi, length, least = np.zeros(n, np.int64), np.full(n, self.size, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        out = []
        for step in range(int((end - start).max(initial=0))):
            here = np.flatnonzero(end - 1 - step >= start)
            going = here
            while len(going):
                a, b = self.extended(s[end[going] - 1 - step], lo[going], hi[going])
                some = np.flatnonzero(a < b)
                value = self.values.least(a[some], b[some])
                fits = value < below[going[some]]
                some, value = some[fits], value[fits]
                met = going[some]
                lo[met], hi[met], least[met] = a[some], b[some], value
                length[met] += 1
                failed = np.ones(len(going), bool)
                failed[some] = False
                going = going[failed]
                going = going[length[going] > 0]  # nothing is left to cut: no match here, and the next one starts anew
                lo[going], hi[going], length[going] = self.shortened(lo[going], hi[going])
            met = here[length[here] > 0]
            out.append((end[met] - 1 - step, length[met], least[met]))
        return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))


def shared_starts(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order of suffixes, how many symbols other than 0 its suffix shares with the one before; 0 at the first, and one 0 after
    the last."""
    shared = np.zeros(len(s) + 1, np.int32)
    going, k = np.arange(1, len(s)), 0
    while len(going):
        own = s[order[going] + k]
        going = going[(own == s[order[going - 1] + k]) & (own != 0)]
        shared[going] += 1
        k += 1
    return shared


#: Stretches streamed at a time.
STREAM = 1 << 15


def possible(rows: list[list[int]], pdf: pd.DataFrame) -> list[np.ndarray]:
    """For each stretch, which windows may also be in another of its anchor: those that reach from `left` to under left + STEP words before the anchor
    hold what these have in common, and another stretch must hold it at the same place."""
    seen: dict[tuple, int] = {}
    own = []
    for row, anchor, at, windows in zip(rows, pdf["anchor"], pdf["offset"], pdf["windows"], strict=True):
        pieces = []
        for left in range((at - windows + 1) // STEP * STEP, at + 1, STEP):
            piece = (anchor, left, *row[max(0, at - left) : at - left - STEP + 1 + WIDTH])
            seen[piece] = seen.get(piece, 0) + 1
            pieces.append((left, piece))
        own.append(pieces)
    out = []
    for pieces, at, windows in zip(own, pdf["offset"], pdf["windows"], strict=True):
        lefts = [left for left, piece in pieces if seen[piece] > 1]
        some = np.array([at - left - k for left in lefts for k in range(STEP)], np.int64)
        out.append(some[(some >= 0) & (some < windows)])
    return out


def judge(pdf: pd.DataFrame) -> list[bytes]:
    """For each window of each stretch, eight bytes: the smallest doc_id among the stretches whose longest match with the window's start is reported, or
    else its own. It is below the stretch's own wherever a stretch of the shard with a smaller one holds the window."""
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in content.split()] for content in pdf["content"]]
    first = pdf["first"].to_numpy(np.int64)
    marks = [np.full(windows, own, np.int64) for windows, own in zip(pdf["windows"], first, strict=True)]
    asked = possible(rows, pdf)
    held = np.array([k for k, windows in enumerate(asked) if len(windows)], np.int64)
    if len(held):
        sizes = np.array([len(rows[k]) for k in held])
        words = np.array([x for k in held for x in (*rows[k], -1)], np.int64)
        s = np.unique(words, return_inverse=True)[1]  # the end of a stretch is the least symbol
        ids, rank = np.unique(first[held], return_inverse=True)
        index = Index(s, int(s.max()) + 1, np.repeat(rank.astype(np.int32), sizes + 1))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        begin = starts + np.array([asked[k].min() for k in held])
        end = starts + np.array([asked[k].max() for k in held]) + WIDTH
        for at in range(0, len(held), STREAM):
            some = slice(at, at + STREAM)
            place, length, least = index.statistics(s, begin[some], end[some], rank[some])
            reached = length >= WIDTH
            place, least = place[reached], ids[least[reached]]
            owner = np.searchsorted(starts, place, side="right") - 1
            for k, window, doc_id in zip(held[owner].tolist(), (place - starts[owner]).tolist(), least.tolist(), strict=True):
                marks[k][window] = doc_id
    return [x.tobytes() for x in marks]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, kept (the remaining words), n_words, n_removed, kept_sha256."""
    joined = with_verdicts(*search(docs.select("doc_id", "text"), Words(), False, judge))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        none = np.zeros(0, np.int64)

        def rows():
            for doc_id, text, _, first, found in texts(batches):
                words = text.encode().split()
                own = LAST if doc_id is None else doc_id
                if first is not None and first < own:
                    gone = np.full(len(words), len(words) >= WIDTH)
                else:
                    some = np.concatenate([none, *(a[m < own] for a, m in marked_windows(found, np.int64))])
                    gone = covered(len(words), some, WIDTH) if len(some) else none
                n = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
                yield doc_id, kept.decode(), len(words), n, hashlib.sha256(kept).hexdigest()

        return chunks(rows(), schema, 512)

    return joined.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
