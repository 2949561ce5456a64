"""Byte and word deduplication against brute force, also where anchors are crowded; the index structures against sorting."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from cases import folder, ordered, outcome, rows

from thalweg.llm import fm_dedup, repeats, suffix_dedup


def marked(raws, width):
    """For each text, its bytes that lie in strings of that width which also start elsewhere."""
    times = Counter(raw[i : i + width] for raw in raws for i in range(len(raw) - width + 1))
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if times[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        yield gone


def bytes_by_force(found):
    raws = [(t or "").encode() for _, t in found]
    for (doc_id, _), raw, gone, short in zip(found, raws, marked(raws, 400), marked(raws, 288), strict=True):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield doc_id, len(raw), int(gone.sum()), spans, sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest(), int(short.sum())


def words_by_force(found, width=13):
    least = {}
    texts = [(repeats.LAST if i is None else i, (t or "").encode().split()) for i, t in found]
    for i, words in texts:
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            least[window] = min(least.get(window, repeats.LAST), i)
    for (doc_id, _), (i, words) in zip(found, texts, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if least[tuple(words[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        yield doc_id, len(words), sum(gone), sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_bytes(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    df = suffix_dedup.op1_suffix_dedup(spark, folder(spark, tmp_path, rows()))
    assert outcome(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == ordered(bytes_by_force(rows()))


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_words(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    df = fm_dedup.op6_fm_dedup(spark, folder(spark, tmp_path, rows()))
    assert outcome(df, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(words_by_force(rows()))


def test_one_header_and_many_bodies(spark, tmp_path, monkeypatch):
    """Windows that very many texts share, each going on in its own way, some in the same: no shard gets more of an anchor than CROWD."""
    r = random.Random(3)
    header = "".join(r.choices("abcdefgh ", k=300))
    bodies = ["".join(r.choices("abcdefgh ", k=200)) for _ in range(290)]
    found = [(k, header + b) for k, b in enumerate([*bodies, *bodies[:10]])] + [(400 + k, f"{k}{header}{b}x") for k, b in enumerate(bodies[:5])]
    monkeypatch.setattr(repeats, "CROWD", 16)
    whole = suffix_dedup.judge

    def checked(pdf):
        if pdf.groupby("anchor").size().max() > 16:
            raise ValueError("a crowd in one shard")
        return whole(pdf)

    monkeypatch.setattr(suffix_dedup, "judge", checked)
    df = suffix_dedup.op1_suffix_dedup(spark, folder(spark, tmp_path, found))
    assert outcome(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == ordered(bytes_by_force(found))


def test_whole_table(spark, sf):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert outcome(fm_dedup.op6_fm_dedup(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(words_by_force(found))
    assert outcome(suffix_dedup.op1_suffix_dedup(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == ordered(bytes_by_force(found))


def test_empty_table(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [])
    assert fm_dedup.op6_fm_dedup(spark, sf_dir).count() == suffix_dedup.op1_suffix_dedup(spark, sf_dir).count() == 0


@pytest.mark.parametrize("whole", [suffix_dedup.WHOLE, 0])
@pytest.mark.parametrize("symbols", [1, 2, 3, 200])
def test_suffix_array(symbols, whole, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WHOLE", whole)
    r = random.Random(symbols)
    for n in (1, 2, 3, 17, 300):
        s = [r.randrange(symbols) for _ in range(n)]
        sa = suffix_dedup.suffix_array(s, symbols - 1)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:])
        sa, prefix = sa.tolist(), suffix_dedup.permuted_prefixes(np.array(s), sa, np.full(n, n)).tolist()
        for a, b in zip(sa, sa[1:], strict=False):
            assert s[a : a + prefix[b]] == s[b : b + prefix[b]] and s[a + prefix[b] : a + prefix[b] + 1] != s[b + prefix[b] : b + prefix[b] + 1]


@pytest.mark.parametrize("symbols", [1, 2, 4, 50])
def test_matching_statistics(symbols):
    """Each place's longest string that a row with a smaller value holds too, and the least value of those that do, against looking everywhere."""
    r = np.random.default_rng(symbols)
    rows = [r.integers(1, symbols + 1, r.integers(1, 20)).tolist() for _ in range(60)]
    rows += [rows[0], rows[1][:5], [*rows[2], *rows[3]]]
    values = r.permutation(len(rows) // 2).tolist() * 2 + [7] * 2
    values = values[: len(rows)]
    s = np.array([x for row in rows for x in (*row, 0)])
    sizes = np.array([len(row) + 1 for row in rows])
    starts = np.cumsum(sizes) - sizes
    index = fm_dedup.Index(s, symbols + 1, np.repeat(np.array(values, np.int32), sizes))
    assert suffix_dedup.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    found = index.statistics(s, starts, starts + sizes - 1, np.array(values))
    holders = {}
    for row, value in zip(rows, values, strict=True):
        for i in range(len(row)):
            for j in range(i + 1, len(row) + 1):
                holders[tuple(row[i:j])] = min(value, holders.get(tuple(row[i:j]), value))
    expected = []
    for row, value, start in zip(rows, values, starts.tolist(), strict=True):
        for i in range(len(row)):
            most = max((j for j in range(i + 1, len(row) + 1) if holders[tuple(row[i:j])] < value), default=i)
            if most > i:
                expected.append((start + i, most - i, holders[tuple(row[i:most])]))
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == expected


def test_minima():
    r = np.random.default_rng(3)
    values = r.integers(0, 99, 77)
    minima = fm_dedup.Minima(values)
    a = r.integers(0, 76, 50)
    b = np.minimum(77, a + 1 + r.integers(0, 40, 50))
    assert minima.least(a, b).tolist() == [values[i:j].min() for i, j in zip(a, b, strict=True)]
    values[[0, -1]] = 0
    minima, bound = fm_dedup.Minima(values), r.integers(1, 99, 50)
    assert minima.smaller_left(a, bound).tolist() == [max(k for k in range(i + 1) if values[k] < x) for i, x in zip(a, bound, strict=True)]
    assert minima.smaller_right(a, bound).tolist() == [min(k for k in range(i, 77) if values[k] < x) for i, x in zip(a, bound, strict=True)]
