"""Byte-pair encoding by backtracking: exact merges in linear time, and decoding by an offset table.

A pre-token's longest token matches come from an Aho-Corasick automaton over the vocabulary. The encoder takes the longest match, keeps it if
the pair with the token before it is compatible (no earlier merge would have joined bytes across their border), else falls back to the next
shorter token that is a prefix, and gives up a position at most once; so each position is settled once. Compatibility of a pair follows from
the merge table alone and is remembered. The vocabulary file is a parameter; nothing is trained.

Added tokens of the vocabulary (its end-of-text mark) are cut out of a text before anything else, as the library does. Nulls and empty texts
have no tokens. Texts are encoded whole; a pre-token of any length takes linear time. Equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.common import documents, map_rows

#: The byte-level pre-tokenizer's pattern (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pre-tokens that a task remembers, the longest remembered, in characters, and the pairs of tokens that it remembers.
REMEMBERED, LONGEST, PAIRS = 300_000, 48, 200_000
#: A pair of tokens as one number: the left one's id plus one (0: none) above these bits, the right one's id in them.
ID_BITS = 24


def vocabulary() -> str:
    """The default vocabulary file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Tables of one vocabulary, and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        self.byte_of = {ord(c): b for b, c in enumerate(chars)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *added.values()]) + 1
        raw = [b""] * n
        for t, i in vocab.items():
            raw[i] = bytes(self.byte_of[ord(c)] for c in t)
        #: By id: bytes of a token, the rank of its merge (-1: none), and the two halves of that. Single bytes are their own halves.
        self.size, self.made = [len(x) for x in raw], [-1] * n
        self.left, self.right = list(range(n)), list(range(n))
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left << ID_BITS | right] = r
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = r, left, right
        #: Bytes are held as the characters of the same numbers, so that ASCII text is taken as it is.
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * n  # the longest token that is a proper prefix
        within: list[tuple[str, int]] = []
        for t, i in sorted((raw[i].decode("latin-1"), i) for i in vocab.values()):
            self.automaton.add_word(t, i)
            while within and not t.startswith(within[-1][0]):
                within.pop()
            if within:
                self.shorter[i] = within[-1][1]
            within.append((t, i))
        self.automaton.make_automaton()
        self.fitting = _Remembered(self._longest_fitting, PAIRS)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self.pre = regex.compile(PATTERN)
        self.cache = _Pieces(self.encode_piece, REMEMBERED)
        #: Decoding: all tokens' bytes in one array, and where each token's bytes begin.
        for t, i in added.items():
            raw[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _longest_fitting(self, pair: int) -> int:
        """The longest token that is the right one of a pair or a prefix of it, and whose border with the left one holds; -1 if there is none."""
        left, token = (pair >> ID_BITS) - 1, pair & (1 << ID_BITS) - 1
        while left >= 0 and token >= 0 and not self._border_holds(left, token):
            token = self.shorter[token]
        return token

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo merges from the last to the first on either side of the border. A merge across it between two states of the sides counts if
        # both were whole by then and neither had been used up: it must come before the merge that replaced the left part, and not after
        # the one that replaced the right part (of two equal ranks the left one goes first).
        limit = len(self.rank)
        while True:
            across = self.rank.get(a << ID_BITS | b)
            if across is not None and across < limit:
                return False
            ra, rb = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        n, size, fitting = len(text), self.size, self.fitting
        longest = [-1] * n
        if n > LONGEST:  # all places at once, which takes linear time; short pieces find them as they come to them
            for end, token in self.automaton.iter(text):
                start = end + 1 - size[token]
                if longest[start] < 0 or size[token] > size[longest[start]]:
                    longest[start] = token
        out: list[int] = []
        closed = bytearray(n + 1)
        pos = before = 0  # before: the last token's part of a pair
        while pos < n:
            if longest[pos] < 0:
                for end, token in self.automaton.iter_long(text, pos):  # the longest match here, the longest one behind it, and so on
                    start = end + 1 - size[token]
                    if longest[start] >= 0:
                        break
                    longest[start] = token
            token = fitting[before | longest[pos]]
            while token < 0 or closed[pos + size[token]]:
                if token < 0:
                    closed[pos] = 1
                    token = out.pop()
                    pos -= size[token]
                    before = (out[-1] + 1) << ID_BITS if out else 0
                token = self.shorter[token]
                if token >= 0:
                    token = fitting[before | token]
            out.append(token)
            pos += size[token]
            before = (token + 1) << ID_BITS
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        get, pieces = self.cache.__getitem__, self.pre.findall
        if self.split_added is None or not self.split_added.search(text):
            return b"".join(map(get, pieces(text)))
        out = []
        for part in self.split_added.split(text):
            out.append(np.array([self.added[part]], "<u4").tobytes() if part in self.added else b"".join(map(get, pieces(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for: each token's slice of the offset table, laid end to end."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        begin, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        end = np.cumsum(size)
        return self.bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)].tobytes()


class _Remembered(dict):
    """What make gives for a key, for up to `room` keys: when half of them are there, they become the older half, and of the older half before
    them only what is asked for again stays. So memory stays bounded, and what is frequent is kept."""

    def __init__(self, make, room: int):
        self.make, self.half, self.older = make, room // 2, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class _Pieces(_Remembered):
    """Encoded pre-tokens; long ones are not kept."""

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece) if len(piece) > LONGEST else super().__missing__(piece)


@cache
def load(path: str) -> Bpe:
    """One set of tables for each worker process."""
    return Bpe(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with ids (binary, little-endian 32-bit) and n_tokens."""

    def make():
        bpe = load(path or vocabulary())

        def row(x: str) -> tuple:
            ids = bpe.encode(x)
            return ids, len(ids) // 4

        return row

    return map_rows(df, make, "ids binary, n_tokens long", text)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df without its ids, with the decoded text."""

    def make():
        bpe = load(path or vocabulary())
        return lambda ids: (bpe.decode(ids or b"").decode("utf-8", "replace"),)

    return map_rows(df, make, "text string", "ids")


def tokenized(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with ids (array of int) and n_tokens; a text whose ids do not decode to it stops the job."""

    def make():
        bpe = load(path or vocabulary())

        def row(x: str) -> tuple:
            ids = bpe.encode(x)
            if bpe.decode(ids) != x.encode():
                raise ValueError("a text does not survive encoding and decoding")
            return np.frombuffer(ids, "<i4"), len(ids) // 4

        return row

    return map_rows(df, make, "ids array<int>, n_tokens long", text)


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with n_tokens and digests of the ids and of the text decoded from them."""

    def make():
        bpe = load(path or vocabulary())

        def row(x: str) -> tuple:
            ids = bpe.encode(x)
            back = bpe.decode(ids).decode("utf-8", "replace").encode()
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        return row

    return map_rows(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", text)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
