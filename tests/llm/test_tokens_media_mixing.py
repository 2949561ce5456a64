"""Tokens against the library, media by round trips and damage, mixing against its SQL and its promises."""

import zlib
from hashlib import sha256

import duckdb
import public_tokenizers
import pytest
from cases import folder, ordered, outcome, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thalweg.llm import bpe, mixing, mpeg


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens(spark, sf, tmp_path):
    odd = ["<|endoftext|> a<|endoftext|><|endo", "it's 'we've  \n\n x\t ", "\U0001f468‍\U0001f469 你好", "a" * 5000, "=" * 3000, "1234567 12²"]
    some = [*rows(), *enumerate(odd, 200)]
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for found, sf_dir in ((some, folder(spark, tmp_path, some)), (whole, sf)):

        def row(i, t):
            ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            return i, len(ids), sha256(raw).hexdigest(), sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

        assert outcome(bpe.op7_bpe(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(row(i, t) for i, t in found)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehinorst '\n1!", max_size=60))
def test_tokens_of_any_text(text):
    own = bpe.load(bpe.vocabulary())
    ids = own.encode(text)
    assert ids == b"".join(x.to_bytes(4, "little") for x in LIBRARY.encode(text, add_special_tokens=False).ids)
    assert own.decode(ids).decode() == text


def test_frequent_pieces_stay_in_small_caches(monkeypatch):
    """What is asked for again and again is encoded once, however many others come between; ids are the same with room for hardly anything."""
    encoded = []
    plain = bpe.Bpe.encode_piece
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    monkeypatch.setattr(bpe, "PAIRS", 4)
    monkeypatch.setattr(bpe.Bpe, "encode_piece", lambda self, piece: encoded.append(piece) or plain(self, piece))
    text = "".join(f" wherer {a}{b}thonre" for a in "abcdefghij" for b in ("nt", "sh", "ûr"))
    ids = bpe.Bpe(bpe.vocabulary()).encode(text)
    assert ids == b"".join(x.to_bytes(4, "little") for x in LIBRARY.encode(text, add_special_tokens=False).ids)
    assert encoded.count(" wherer") == 1 and len(encoded) == 31


def test_long_pieces_take_linear_time():
    """Pieces of one pre-token each, over LONGEST characters, with borders that fall back again and again."""
    own = bpe.load(bpe.vocabulary())
    for text in ("thonre" * 5000, "a" * 30001, "=" * 30001, "é" * 9999, "a" * bpe.LONGEST, "ab" * (bpe.LONGEST // 2) + "c"):
        assert own.encode(text) == b"".join(x.to_bytes(4, "little") for x in LIBRARY.encode(text, add_special_tokens=False).ids)


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    assert ordered(map(tuple, bpe.decode(bpe.encode(df)).select("doc_id", "text").collect())) == [(1, "hello world"), (2, "")]


def test_media(spark, tmp_path):
    def row(i, t):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = mpeg.write(payload)
        return i, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest()

    df = mpeg.op8_mpeg(spark, folder(spark, tmp_path, rows()))
    assert outcome(df, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == ordered(row(i, t) for i, t in rows())
    assert df.where("feature NOT LIKE '%bad_crc=0;junk=0'").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_any_payload_comes_back(payload):
    assert mpeg.read(mpeg.write(payload)).payload == payload


def test_damaged_streams():
    payload = b"\xff\xfb\x90\x00 abc" * 700
    media = mpeg.write(payload)
    whole = mpeg.read(media)
    assert whole.table == "Info" and whole.table_frames == len(whole.offsets) and whole.tags == ["ID3v2.4"]
    assert whole.samples == 1152 * len(whole.offsets) and whole.seek(0) == whole.offsets[0] and whole.seek(whole.seconds + 1) is None
    second = whole.offsets[1]
    junk = mpeg.read(media[:second] + b"\0" * 37 + media[second:])
    assert junk.junk == 37 and len(junk.offsets) == len(whole.offsets) and junk.payload == payload
    bad = bytearray(media)
    bad[second + 8] ^= 1
    assert mpeg.read(bytes(bad)).bad_crc == 1
    assert mpeg.read(media + b"TAG" + bytes(125)).tags == ["ID3v2.4", "ID3v1"]
    assert mpeg.read(b"").samples == mpeg.read(b"no audio here").samples == 0
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x64)))[:7] == (True, 3, False, 128, 44100, False, 417)


def test_tables_and_short_frames():
    """Seek points of both kinds of table, and frames too short for the table that they begin."""
    media = mpeg.write(b"x" * 20000)
    found = mpeg.read(media)
    head = len(media) - (len(found.offsets) + 1) * mpeg._HEAD.size
    assert len(found.points) == 100 and found.points[0] == head and found.points == sorted(found.points) and found.points[50] == head + 128 * (len(media) - head) // 256
    four = bytes((0xFF, 0xFB, 0x90, 0x64))
    size = mpeg.header(four).size
    vbri = (four + bytes(32) + b"VBRI" + bytes(10) + (3).to_bytes(4, "big") + (3).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + size.to_bytes(2, "big") * 3).ljust(size, b"\0")
    found = mpeg.read(vbri + (four + bytes(size - 4)) * 3)
    assert found.table == "VBRI" and found.table_frames == 3 and found.points == [size, 2 * size, 3 * size] == found.offsets
    short = bytes((0xFF, 0xF3, 0x10, 0x00)) + bytes(17) + b"Info\0"
    assert mpeg.read(short).table == "" and mpeg.read(short[:9]).offsets == []


@pytest.mark.parametrize("third, layer, rate, bits", [(0xFF, 1, 0x90, 32 * 4 * 2), (0xFD, 2, 0xA0, 11 * 8 + 12 * 6 + 7 * 4 + 2)])
def test_checksums_of_the_lower_layers(third, layer, rate, bits):
    """Allocations are protected; in Layer II so are two bits for each subband that has any."""
    four = bytes((0xFF, third - 1, rate, 0x00))
    h = mpeg.header(four)
    assert h.layer == layer and h.crc
    body = (bytes((0x10,)) if layer == 2 else bytes((0x35,))).ljust(h.size - 6, b"\0")
    assert mpeg.protected_bits(h, body[:64]) == bits
    frame = four + mpeg.crc16_bits(four[2:] + body, 16 + bits).to_bytes(2, "big") + body
    assert mpeg.read(frame * 3).bad_crc == 0
    damaged = bytearray(frame)
    damaged[7] ^= 0x80
    assert mpeg.read(frame + bytes(damaged) + frame).bad_crc == 1


def test_media_and_tokens_of_nothing(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [])
    assert mpeg.op8_mpeg(spark, sf_dir).count() == bpe.op7_bpe(spark, sf_dir).count() == 0


@pytest.mark.parametrize("ranges", [mixing.RANGE_ROWS, 2])
def test_mixing(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    found = [*rows(), *((i, f"w{i} " * (i % 17)) for i in range(300, 400))]
    sf_dir = folder(spark, tmp_path, found)
    df = mixing.op5_mixing(spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert outcome(df, *columns) == ordered(con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall()) == outcome(mixing.op5_mixing(spark, sf_dir), *columns)
    by = {}
    for _, size, source_size, target, taken in outcome(df, *columns):
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, target), []).append(taken)
    total = sum(s for s, _ in by)
    assert all(abs(sum(v) - t) <= 0.5 and t <= 2 * s for (s, t), v in by.items())
    assert abs(sum(t for _, t in by) - min(1.5 * total, 2 * total)) < 0.01


def test_mixed_rows(spark, tmp_path):
    docs = spark.read.parquet(folder(spark, tmp_path, rows()) + "/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = sum(len(r.text.encode().split()) for r in out.collect())
    assert words == mixing.mix(mixing.sized(docs)).agg({"taken": "sum"}).first()[0]
    assert {r.text for r in out.collect() if r.n_chars != len(r.text)} == set()


def test_mixing_nothing(spark, tmp_path):
    assert mixing.op5_mixing(spark, folder(spark, tmp_path / "a", [])).count() == 0
    none = mixing.op5_mixing(spark, folder(spark, tmp_path / "b", [(1, None), (2, " ")]))
    assert outcome(none, "doc_id", "size", "taken") == [(1, 0, 0), (2, 0, 0)]
