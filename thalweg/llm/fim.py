"""Fill-in-middle transformation: a text is cut in three, and its parts are put in another order between sentinels.

A whole Arrow batch is worked on at once, on its UTF-8 buffers. A table of byte classes and a mask over adjacent bytes say where units (lines,
words, characters) begin; running sums that start anew with each document number them; one binary search finds the cuts of all rows, and one
gather puts all outputs together. There is no loop over rows. Batches are taken in slices of CHUNK bytes (one row, if it is longer), which bounds
what a task holds.

The first four groups of 32 bits of a SHA-256 of the seed and doc_id decide: two cuts, whether a text is transformed, and its form. The prefix ends
after the smaller number of units, the middle after the larger. psm is prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text as it is:
for empty texts, texts that hold a sentinel, and those that `rate` leaves out. Sentinels are <...> with neither < nor > inside, so that none arises
where parts meet, and `restored` finds the parts again from output and form alone.

Null texts are empty: plain, 0 units, no prefix or middle. A null doc_id hashes as the word null. Repeated rows give the same output, an empty table
an empty result. Other columns are kept, but for those with the name of a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import documents, small_batches

#: Bytes of text worked on at a time.
CHUNK = 4_000_000
FORMS = np.array(["plain", "psm", "spm"])
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"

_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: A unit begins where the byte before and the byte itself are in these classes, and at the start of a document.
UNITS = {
    "lines": (_BYTES == 10, np.ones(256, bool)),
    "words": (_SPACE, ~_SPACE),
    "chars": (np.ones(256, bool), (_BYTES & 0xC0) != 0x80),
}


@dataclass(frozen=True)
class Options:
    """What is cut, what stands between parts, which share of texts (in hundredths) is transformed, and which share of these becomes spm."""

    unit: Literal["lines", "words", "chars"] = "lines"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm: int = 50
    seed: str = "7"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or "<" in m[1:] or ">" in m[:-1] for m in marks):
            raise ValueError("sentinels must be three different ones of the form <...>")

    @property
    def marks(self) -> list[np.ndarray]:
        return [np.frombuffer(m.encode(), np.uint8) for m in (self.prefix, self.suffix, self.middle)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of texts without nulls; offsets begin at 0."""
    texts = texts.cast(pa.large_utf8())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def as_texts(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of texts on these bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_utf8(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.utf8())


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of source, one after another."""
    at = np.cumsum(lengths) - lengths
    return source[np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))]


def places(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where a sentinel begins."""
    if len(data) < len(mark):
        return np.zeros(0, np.int64)
    is_at = data[: len(data) - len(mark) + 1] == mark[0]
    for k in range(1, len(mark)):
        is_at &= data[k : len(data) - len(mark) + 1 + k] == mark[k]
    return np.flatnonzero(is_at)


def transform(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, options: Options) -> tuple[np.ndarray, ...]:
    """Texts and their four hash numbers -> n, form (place in FORMS), prefix_chars, middle_chars, bytes of outputs, their lengths."""
    start, end = offsets[:-1], offsets[1:]
    before, at = UNITS[options.unit]
    begins = np.zeros(len(data), bool)
    begins[1:] = before[data[:-1]] & at[data[1:]]
    begins[start[start < end]] = True
    unit = np.concatenate([[0], np.cumsum(begins)])
    n = unit[end] - unit[start]
    few, more = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    # The byte where the unit after k units begins; after all of them, the end.
    cut = lambda k: np.where(k == n, end, np.searchsorted(unit, unit[start] + k + 1) - 1)
    first, second = cut(few), cut(more)
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    marks = options.marks
    plain = (start == end) | (h[:, 2] % 100 >= options.rate)
    for mark in marks:
        found = places(data, mark)
        plain |= np.searchsorted(found, np.maximum(end - len(mark) + 1, start)) > np.searchsorted(found, start)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < options.spm, 2, 1))

    source = np.concatenate([data, *marks])
    mark_at = len(data) + np.cumsum([0, len(marks[0]), len(marks[1])])
    rows = np.ones(len(n), np.int64)
    prefix, middle, suffix = (start, first - start), (first, second - first), (second, end - second)
    p, s, m = ((a * rows, len(mark) * rows) for a, mark in zip(mark_at, marks, strict=True))
    orders = [[(start, end - start), *[(start, 0 * rows)] * 5], [p, prefix, s, suffix, m, middle], [s, suffix, p, prefix, m, middle]]
    starts, lengths = (np.stack([np.choose(form, [o[k][x] for o in orders]) for k in range(6)], axis=1) for x in (0, 1))
    return n, form, char[first] - char[start], char[second] - char[first], gathered(source, starts.ravel(), lengths.ravel()), lengths.sum(axis=1)


def restore(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and their forms -> bytes of the texts, their lengths. Each sentinel occurs once in an output that is not plain."""
    start, end = offsets[:-1], offsets[1:]
    none = np.zeros(len(start), np.int64)
    at = []
    for mark in options.marks:
        found = np.concatenate([places(data, mark), [0]])
        at.append(np.where(form > 0, found[np.minimum(np.searchsorted(found[:-1], start), len(found) - 1)], start))
    p, s, m = at
    after = [x + len(mark) for x, mark in zip(at, options.marks, strict=True)]
    pieces = [
        [(start, end), (after[0], s), (after[0], m)],
        [(start, none + start), (after[2], end), (after[2], end)],
        [(start, none + start), (after[1], m), (after[1], p)],
    ]
    starts, ends = (np.stack([np.choose(form, [f[x] for f in piece]) for piece in pieces], axis=1) for x in (0, 1))
    return gathered(data, starts.ravel(), (ends - starts).ravel()), (ends - starts).sum(axis=1)


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHUNK bytes of text."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _mapped(df: DataFrame, text: str, fields: str, drop: tuple[str, ...], make: Callable[[pa.RecordBatch, dict[str, int]], list[pa.Array]]) -> DataFrame:
    """df without `drop`, with `fields` that make() gives for a slice of a batch; columns of df with their names give way."""
    new = T._parse_datatype_string(fields).fields
    taken = {f.name.lower() for f in new}
    keep = [f for f in df.schema.fields if f.name not in drop and f.name.lower() not in taken]
    place = {c: i for i, c in enumerate(df.columns)}
    names = [f.name for f in [*keep, *new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, place[text]):
                yield pa.RecordBatch.from_arrays([*(part.column(place[f.name]) for f in keep), *make(part, place)], names)

    return small_batches(df).mapInArrow(run, T.StructType([*keep, *new]))


def transformed(docs: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """docs without the text, with FIELDS."""
    key = F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    given = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.unhex(F.sha2(key, 256)).alias("__hash"))

    def make(part: pa.RecordBatch, place: dict[str, int]) -> list[pa.Array]:
        hashes = part.column(place["__hash"])
        h = np.frombuffer(b"".join(hashes.to_pylist()), ">u4").reshape(len(hashes), 8)[:, :4].astype(np.int64)
        n, form, prefix, middle, out, lengths = transform(*buffers(part.column(place["__text"])), h, options)
        chars = lambda x: pa.array(x, pa.int64(), mask=form == 0)
        return [pa.array(n), pa.array(FORMS[form]), chars(prefix), chars(middle), as_texts(out, lengths)]

    return _mapped(given, "__text", FIELDS, ("__text", "__hash"), make)


def restored(outputs: DataFrame, options: Options = Options()) -> DataFrame:
    """outputs (output, form and any other columns) with `text`, put together again from output and form."""

    def make(part: pa.RecordBatch, place: dict[str, int]) -> list[pa.Array]:
        kinds = np.array(part.column(place["form"]).to_pylist())
        form = (kinds == FORMS[1]) + 2 * (kinds == FORMS[2])
        return [as_texts(*restore(*buffers(part.column(place["output"])), form, options))]

    return _mapped(outputs, "output", "text string", (), make)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = restored(transformed(documents(spark, sf_dir, "doc_id", "text")))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
