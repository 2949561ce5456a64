"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random
import time
from itertools import combinations

import corpus_pipeline as pipeline
import numpy as np
import pytest
from cases import folder

from thalweg.llm import near_copies, simhash


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = low.encode().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def expected(found):
    """The least doc_id of each component, and how many pairs link."""
    sets, parent, n = [shingles(t) for _, t in found], list(range(len(found))), 0

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(range(len(found)), 2):
        same = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * same >= 4 * len(sets[a] | sets[b]) > 0:
            parent[root(b)] = root(a)
            n += 1
    least = {}
    for k, (i, _) in enumerate(found):
        least.setdefault(root(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=lambda i: (i is None, i)), n


def kept(spark, path, found):
    sf_dir = folder(spark, path, found)
    return sorted(r.doc_id for r in pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect())


def edited():
    """Texts with one copy each, edited at places a shingle apart: similarities from about 0.6 to 0.95."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    out = []
    for k in range(90):
        body = [word() for _ in range(r.randint(80, 160))]
        copy = list(body)
        for at in range(6, 6 + 7 * (1 + k % 5), 7):
            copy[at] = word()
        out += [" ".join(body), " ".join(copy)]
    return list(enumerate(out))


def crowd():
    """A passage that many unlike texts share, and a group of near copies of it that chain: both crowd the same keys."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = [word() for _ in range(60)]
    out = [" ".join([*passage, *(word() for _ in range(r.randint(5, 30)))]) for _ in range(40)]
    for k in range(40):
        copy = list(passage)
        copy[k + 8] = word()
        out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("bucket, block, sample, common", [(128, 1024, 16, 8), (2, 7, 1, 8)])
def test_no_pair_is_lost(spark, tmp_path, monkeypatch, bucket, block, sample, common):
    for name, x in (("BUCKET", bucket), ("BLOCK", block), ("SAMPLE", sample), ("COMMON", common)):
        monkeypatch.setattr(near_copies, name, x)
    for k, found in enumerate((edited(), crowd())):
        ids, n = expected(found)
        assert n >= 20 and kept(spark, tmp_path / str(k), found) == ids


def test_unlike_texts_stay(spark, tmp_path):
    """Short texts whose sparse fingerprints are near zero or near one another, and longer ones that share less than 0.8."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    short = [" ".join(word() for _ in range(6)) for _ in range(300)]
    assert any(simhash.fingerprint(t, 5).bit_count() <= 9 for t in short)
    body = [word() for _ in range(60)]
    part = [" ".join([*body, *(word() for _ in range(n))]) for n in (0, 14, 15, 16, 20)]
    found = list(enumerate([None, "", " \n", *short, *part, "one two", "One  Two"], 1))
    ids, _ = expected(found)
    assert ids[:2] == [1, 4] and kept(spark, tmp_path, found) == ids


def test_texts_of_one_passage_stay(spark, tmp_path):
    """Texts that hold one passage and go on differently: only those go that chain by verified edges."""
    found = crowd()[:40]
    assert kept(spark, tmp_path, found) == expected(found)[0]


def test_prefixes_cost_their_sets_not_the_common_shingles():
    """The same as by np.isin, of few and of MOST common shingles; of these 1000 sets took over 10 s when each went through all that is common."""
    rng = np.random.default_rng(9)
    common = np.unique(rng.integers(-(1 << 62), 1 << 62, near_copies.MOST))
    sets = [np.unique(np.concatenate([rng.choice(common, 40), rng.integers(-(1 << 62), 1 << 62, 60)])) for _ in range(1000)]
    start = time.process_time()
    found = [near_copies.prefix(s, 0.8, common) for s in sets]
    assert time.process_time() - start < 2
    for few in (common, common[:5], common[:0]):
        for s, p in zip(sets[:20], found, strict=False):
            last = np.isin(s, few)
            want = np.concatenate([s[~last], s[last]])[: len(p)]
            assert (near_copies.prefix(s, 0.8, few) == want).all()
    assert len(near_copies.prefix(common[:0], 0.8, common)) == 0
