"""Fill-in-middle against plain Python, and exact round trips."""

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from cases import folder, ordered, outcome, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.llm import fim

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
SPLITS = {
    "lines": lambda x: re.findall(r"[^\n]*\n|[^\n]+", x),
    "words": lambda x: _words(x),
    "chars": list,
}
MORE = ["a\nb\nc\nd", "\n\n\n", "one line", "has <P> inside\nand more\n", "almost <P\n> <S\n", "<\n<\nP>\n>\n", "é\nüü\n\U0001f600\nx", "\r\n\r\n", "<M>"] * 3


def _words(x):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    at = [i for i in range(len(x)) if i == 0 or (x[i - 1] in space and x[i] not in space)]
    return [x[a:b] for a, b in zip(at, [*at, len(x)][1:], strict=True)]


def plainly(doc_id, text, o=fim.Options()):
    text = text or ""
    digest = sha256(f"{o.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = SPLITS[o.unit](text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in (o.prefix, o.suffix, o.middle)) or h[2] % 100 >= o.rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < o.spm:
        return n, "spm", len(prefix), len(middle), f"{o.suffix}{suffix}{o.prefix}{prefix}{o.middle}{middle}"
    return n, "psm", len(prefix), len(middle), f"{o.prefix}{prefix}{o.suffix}{suffix}{o.middle}{middle}"


def digest(text):
    return sha256((text or "").encode()).hexdigest()


def test_query(spark, sf, tmp_path):
    some = [*rows(), *enumerate(MORE, 1000)]
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for docs, sf_dir in ((some, folder(spark, tmp_path, some)), (whole, sf)):
        want = ordered((i, *(p := plainly(i, t))[:4], digest(p[4]), digest(t)) for i, t in docs)
        assert outcome(fim.op12_fim(spark, sf_dir), *COLUMNS) == want
        assert {r[2] for r in want} >= {"psm", "spm"}


@pytest.mark.parametrize("options", [fim.Options("words", "<pre>", "<suf>", "<mid>", 70, 20, "s"), fim.Options("chars", spm=100), fim.Options(spm=0), fim.Options(rate=0)])
def test_other_units_and_rates(spark, options):
    docs = [*rows(), *enumerate(MORE, 1000)]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, Form string, other string")
    out = fim.transformed(table, options)
    assert out.columns == ["doc_id", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert outcome(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == ordered((i, *plainly(i, t, options)) for i, t in docs)
    assert outcome(fim.restored(out, options), "doc_id", "text") == ordered((i, t or "") for i, t in docs)


def test_sentinels_and_empty_table(spark, tmp_path):
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S<>", "<M>"), ("<>", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.Options("lines", *marks)
    assert fim.op12_fim(spark, folder(spark, tmp_path, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\n <>PSMé\U0001f600", max_size=30), *[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=6), st.sampled_from(["lines", "words", "chars"]))
def test_round_trip_of_any_batch(found, unit):
    options = fim.Options(unit)
    data, offsets = fim.buffers(pa.array(["skipped", *(x[0] for x in found)])[1:])
    n, form, prefix, middle, out, lengths = fim.transform(data, offsets, np.array([x[1:] for x in found], np.int64), options)
    assert [len(SPLITS[unit](x[0])) for x in found] == n.tolist()
    texts = fim.as_texts(out, lengths)
    for x, f, t in zip(found, form, texts.to_pylist(), strict=True):
        assert (f == 0) == (not x[0] or any(m in x[0] for m in ("<P>", "<S>", "<M>"))) and (f != 0 or t == x[0])
    assert fim.as_texts(*fim.restore(*fim.buffers(texts), form, options)).to_pylist() == [x[0] for x in found]
