"""Suffix-array deduplication of bytes.

Every byte goes that is covered by a string of WIDTH bytes which also starts anywhere else, in the same document or another; strings are judged
on the input. Bytes covered by such strings of SHORT bytes are counted beside (about fifty words), and stay. Stretches of text that may hold such
strings (see repeats) meet in shards. A shard's stretches are laid end to end, with a mark after each, and their suffixes are sorted by induction:
suffixes are classified as smaller or larger than the next one, leftmost-smaller substrings are sorted by inducing and named, names that
repeat are sorted recursively (by doubled ranks where there are over WHOLE of them), and the order of all suffixes is induced from theirs in linear time. Permuted common prefixes are computed in
text order; suffixes that share a string's length stand together in the order, and the occurrences of their stretches are summed.

Null and empty texts, and texts shorter than WIDTH, lose nothing (an empty text keeps the digest of no bytes). Repeated rows count as
elsewhere, so each of them loses all its windows. Offsets are bytes of UTF-8; a cut may fall within a character, and the digest is of the
bytes. Very long texts are read whole; only their stretches are shuffled, each to its shard. An empty table gives an empty result. Columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import documents
from thalweg.llm.repeats import Units, covered, marked_windows, runs, scramble, search, with_verdicts
from thalweg.llm.repeats import _chunks as chunks
from thalweg.llm.repeats import _texts as texts

WIDTH, SHORT, GRAM, STEP = 400, 288, 48, 34
_CODES = scramble(np.arange(1, 257))
#: Stands after each stretch: no byte of UTF-8.
END = 255


class Bytes(Units):
    """A text as UTF-8 bytes."""

    width, gram, unit_bytes, least_bytes, reach, range_sizes = SHORT, GRAM, 1, SHORT, WIDTH, (32, 4, 1)

    def read(self, text):
        return text.encode()

    def codes(self, units):
        return _CODES[np.frombuffer(units, np.uint8)]

    def content(self, units, start, end):
        return units[start:end]

    def split(self, content):
        return content

    def crowded(self, n, content):
        """As judge says of a string that occurs elsewhere: 2 if WIDTH bytes do, else 1."""
        return F.when((n > 1) & (F.octet_length(content) >= WIDTH), F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01")))


#: Symbols up to which suffixes are induced, bucket by bucket.
WHOLE = 512


def _induced_whole(s: np.ndarray, smaller: np.ndarray, heads: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order that seeds induce, bucket by bucket: of a bucket's suffixes, all that is known at a time induce what comes before them."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    c, count = np.unique(s[seeds], return_counts=True)
    sa[np.repeat(ends[c] - np.cumsum(count), count) + np.arange(len(seeds))] = seeds
    seeded = ends.copy()
    seeded[c] -= count
    head = heads.copy()

    narrow = s.astype(np.uint16)  # sorted by counting

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        if not len(found):
            return
        symbol = narrow[found]
        by = np.argsort(symbol, kind="stable")
        ordered = symbol[by]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        c, count = ordered[start], np.diff(start, append=len(found))
        rank = np.arange(len(found)) - np.repeat(start, count)
        sa[np.repeat(at[c], count) + (rank if step > 0 else -1 - rank)] = found[by]
        at[c] += step * count

    def before(some: np.ndarray, small: bool) -> np.ndarray:
        j = some - 1
        j = j[j >= 0]
        return j[smaller[j] == small]

    put(np.array([n - 1]), head, 1)  # the last suffix is larger than the end of the text
    for c in range(len(heads)):
        done = heads[c]
        while done < head[c]:
            upto = head[c]
            put(before(sa[done:upto], False), head, 1)
            done = upto
        put(before(sa[seeded[c] : ends[c]], False), head, 1)
    tail = ends.copy()
    for c in range(len(heads) - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            put(before(sa[upto:done][::-1], True), tail, -1)
            done = upto
        put(before(sa[heads[c] : head[c]][::-1], True), tail, -1)
    return sa


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order, by doubling the length that they are ranked by until no two ranks are equal: for many symbols with few suffixes
    each, whose buckets are not worth inducing."""
    n, have = len(s), 1
    rank, order = np.unique(s, return_inverse=True)[1].astype(np.int64), np.argsort(s, kind="stable")
    while n:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - have)] = rank[have:] + 1  # what has ended is the least
        both = rank * (n + 1) + follow
        order = np.argsort(both)
        step = np.concatenate([[False], both[order[1:]] != both[order[:-1]]])
        rank[order] = np.cumsum(step)
        if step.sum() == n - 1:
            break
        have *= 2
    return order


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """The suffixes of s in order, by induced sorting; beyond WHOLE symbols, which names of substrings soon are, by ranks. Symbols are 0 to top."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n <= 1:
        return np.arange(n)
    if top > WHOLE:
        return suffix_order(s)
    # Smaller: the suffix comes before the one that starts a symbol later. Equal symbols inherit, from the last place that differs.
    step = np.sign(s[1:] - s[:-1])
    nonzero = np.where(step != 0, np.arange(n - 1), n)
    upcoming = np.minimum.accumulate(nonzero[::-1])[::-1]
    smaller = np.zeros(n, bool)
    inside = upcoming < n
    smaller[:-1][inside] = step[upcoming[inside]] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=top + 1))
    heads = np.concatenate([[0], ends[:-1]])
    induce = lambda seeds: _induced_whole(s, smaller, heads, ends, seeds)
    if not len(leftmost):
        return induce(leftmost)
    # Names of leftmost-smaller substrings, in the order that inducing from their starts gives.
    place = np.full(n, -1, np.int64)
    place[leftmost] = np.arange(len(leftmost))
    order = induce(leftmost[np.argsort(s[leftmost], kind="stable")])
    order = order[place[order] >= 0]
    size = np.append(leftmost[1:], n - 1)[place[order]] - order + 1
    same = np.concatenate([[False], size[1:] == size[:-1]])
    last = place[order] == len(leftmost) - 1  # the last one is followed by the end of the text: it equals no other
    same &= ~last & ~np.concatenate([[False], last[:-1]])
    going, k = np.flatnonzero(same), 0
    while len(going):
        equal = s[order[going] + k] == s[order[going - 1] + k]
        same[going[~equal]] = False
        k += 1
        going = going[equal & (size[going] > k)]
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(leftmost):
        named = np.empty(len(leftmost), np.int64)
        named[place[order]] = names
        order = leftmost[suffix_array(named, int(names[-1]))]
    return induce(order)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the length that it shares with the one before it in the order, up to its end (ends: after it).

    Where the symbols before both suffixes are equal, it is one less than the suffix before has; the others are compared, eight symbols at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.zeros(n, bool)
    own[0] = True
    j = before[1:]
    own[1:] = (j <= 0) | (before[:-1] < 0) | (s[:-1] != s[j - 1]) | (before[:-1] != j - 1) | (ends[1:] != ends[:-1])
    padded = np.concatenate([s.astype(np.uint8), np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + 9, 8), (1, 1)).copy().view(np.uint64).ravel()
    at = np.flatnonzero(own)
    size = np.zeros(len(at), np.int64)
    going = np.flatnonzero(before[at] >= 0)
    while len(going):
        i = at[going]
        most = np.minimum(ends[i] - i, n - before[i])
        differ = eight[i + size[going]] ^ eight[before[i] + size[going]]
        low = differ & (~differ + np.uint64(1))
        size[going] = np.minimum(most, size[going] + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8))
        going = going[(differ == 0) & (size[going] < most)]
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[at] = size + at
    return np.maximum(full[last] - np.arange(n), 0)


def possible(pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(row, from, to) of the parts of stretches that may hold a window of another of their anchor. A window that reaches d bytes to the left of the
    anchor holds the bytes from the multiple of STEP below d on, up to what the next multiple leaves on the right: such a piece must be shared."""
    seen: dict[tuple, int] = {}
    pieces = []
    for anchor, at, content in zip(pdf["anchor"], pdf["offset"], pdf["content"], strict=True):
        own = []
        for left in range(0, SHORT - GRAM + 1, STEP):
            a, b = at - left, at + SHORT - left - STEP + 1
            if a >= 0 and b <= len(content):
                piece = (anchor, left, content[a:b])
                seen[piece] = seen.get(piece, 0) + 1
                own.append(piece)
        pieces.append(own)
    out = []
    for row, (own, at, content) in enumerate(zip(pieces, pdf["offset"], pdf["content"], strict=True)):
        shared = [left for piece in own if seen[piece] > 1 for left in (piece[1],)]
        if shared:
            out.append((row, max(0, at - max(shared) - STEP + 1), min(len(content), at - min(shared) + WIDTH)))
    return out


def judge(pdf: pd.DataFrame) -> list[bytes]:
    """A byte for each window of each stretch: 0, or 1 if its first SHORT bytes occur elsewhere too, 2 if WIDTH bytes do."""
    lengths = pdf["content"].str.len().to_numpy(np.int64)
    n = pdf["n"].to_numpy(np.int64)
    out = []
    for windows, size, times in zip(pdf["windows"], lengths, n, strict=True):
        marks = np.zeros(windows, np.uint8)
        if times > 1:
            marks[:] = 1 + (np.arange(windows) + WIDTH <= size)
        out.append(marks)
    parts = possible(pdf)
    if not parts:
        return [m.tobytes() for m in out]
    pieces = [pdf["content"][row][a:b] + bytes((END,)) for row, a, b in parts]
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    s = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.repeat(starts + sizes - 1, sizes)
    sa = suffix_array(s, END)
    shared = permuted_prefixes(s, sa, ends)[sa]
    owner = np.repeat(np.arange(len(parts)), sizes)[sa]
    row = np.array([p[0] for p in parts])[owner]
    offset = sa - starts[owner] + np.array([p[1] for p in parts])[owner]
    # Only suffixes that start one of the stretch's own windows count: other stretches hold the others.
    own = np.flatnonzero(offset < pdf["windows"].to_numpy(np.int64)[row])
    if not len(own):
        return [m.tobytes() for m in out]
    shared = np.minimum.reduceat(shared[: own[-1] + 1], np.concatenate([[0], own[:-1] + 1]))
    row, offset = row[own], offset[own]
    for mark, least in ((1, SHORT), (2, WIDTH)):
        group = np.cumsum(shared < least)
        group -= group[0]
        repeated = (np.bincount(group, n[row])[group] > 1) & (offset + least <= lengths[row])
        for r, o in zip(row[repeated].tolist(), offset[repeated].tolist(), strict=True):
            out[r][o] = mark
    return [m.tobytes() for m in out]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes in strings of SHORT bytes that
    also start elsewhere)."""
    joined = with_verdicts(*search(docs.select("doc_id", "text"), Bytes(), True, judge))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())])

    def run(batches):
        def rows():
            for doc_id, text, times, _, found in texts(batches):
                raw = text.encode()
                size = len(raw)
                if (times or 0) > 1:
                    gone, short = np.full(size, size >= WIDTH), np.full(size, size >= SHORT)
                elif not found:
                    yield doc_id, raw, size, 0, 0, hashlib.sha256(raw).hexdigest(), 0
                    continue
                else:
                    some = [(a[m == 2], a[m > 0]) for a, m in marked_windows(found, np.uint8)]
                    gone, short = (covered(size, np.concatenate([np.zeros(0, np.int64), *(x[k] for x in some)]), w) for k, w in ((0, WIDTH), (1, SHORT)))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                yield doc_id, kept, size, int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), int(short.sum())

        return chunks(rows(), schema, 512)

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
