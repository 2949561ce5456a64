"""A media column of MPEG audio streams: written from payload bytes, and read back by a resynchronising parser.

The writer stores a payload losslessly in the main-data bytes of MPEG-1 Layer III frames (320 kbit/s, 32 kHz, mono, CRC on), behind an ID3v2
tag that holds its length and a first frame that holds a variable-bitrate table. The reader works on any MPEG audio bytes: it skips ID3v2
tags, finds frame headers again after junk (a header counts only if a consistent one follows at its end, or the stream ends there), checks
each frame's CRC-16 (of all three layers), reads Xing, Info and VBRI tables with their seek points and ID3v1 tags, and returns the exact duration as
samples over rate, the byte offset of every frame, and the payload if the stream is one of the writer's. Layers I to III of MPEG 1, 2 and 2.5 are understood.

Nulls and empty texts are stored as 64 zero bytes. A text of any length takes linear time, with one frame at a time beside the stream itself.
Equal texts give equal rows, so repeated rows and ties are harmless; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.common import documents, map_rows

#: Fixed values of the format: kbit/s by (MPEG 1?, layer) and index, Hz of MPEG 1 by index.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = (44100, 48000, 32000)

_SYNC = re.compile(rb"\xff[\xe0-\xff]")
_CRC_TABLE = []
for _b in range(256):
    _r = _b << 8
    for _ in range(8):
        _r = (_r << 1 ^ 0x8005 if _r & 0x8000 else _r << 1) & 0xFFFF
    _CRC_TABLE.append(_r)


class Header(NamedTuple):
    mpeg1: bool
    layer: int
    crc: bool
    kbps: int
    hz: int
    mono: bool
    size: int
    samples: int
    side: int
    bound: int  # subbands that two channels have of their own; 32 without joint stereo


@lru_cache(65536)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free-format streams are not supported)."""
    if len(four) < 4:
        return None
    h = int.from_bytes(four, "big")
    version, layer, rate, hz = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    mpeg1, mono, pad = version == 3, h >> 6 & 3 == 3, h >> 9 & 1
    kbps, hz = KBPS[mpeg1, layer][rate], HZ[hz] >> {3: 0, 2: 1, 0: 2}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if mpeg1 else (9 if mono else 17)
    bound = 4 * ((h >> 4 & 3) + 1) if h >> 6 & 3 == 1 and layer < 3 else 32
    return Header(mpeg1, layer, not h >> 16 & 1, kbps, hz, mono, size, samples, side, bound)


#: Fixed values of the format: bits of a subband's allocation in Layer II, as (subbands, bits) from the lowest on.
ALLOCATION = {
    "27 subbands": ((11, 4), (12, 3), (4, 2)),
    "30 subbands": ((11, 4), (12, 3), (7, 2)),
    "8 subbands": ((2, 4), (6, 3)),
    "12 subbands": ((2, 4), (10, 3)),
    "MPEG 2": ((4, 4), (7, 3), (19, 2)),
}


def allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer I or II frame."""
    if h.layer == 1:
        return [4] * 32
    each = h.kbps // (1 if h.mono else 2)
    if not h.mpeg1:
        table = "MPEG 2"
    elif each <= 48:
        table = "12 subbands" if h.hz == 32000 else "8 subbands"
    else:
        table = "27 subbands" if h.hz == 48000 or each <= 80 else "30 subbands"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: Layer III side information, or Layer I and II allocations, and in Layer II two bits more for each
    subband of a channel that has any."""
    if h.layer == 3:
        return 8 * h.side
    word, left, used, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, bits in enumerate(allocation(h)):
        shared = not h.mono and band >= h.bound
        for _ in range(1 if h.mono or shared else 2):
            used += bits
            if left < used:
                return 8 * len(body)
            chosen += (2 if shared else 1) * bool(word >> (left - used) & (1 << bits) - 1)
    return used + (2 * chosen if h.layer == 2 else 0)


@lru_cache(65536)
def crc16(protected: bytes) -> int:
    """The frame checksum (polynomial 0x8005, from 0xFFFF) of the last two header bytes and the side information."""
    r = 0xFFFF
    for b in protected:
        r = (r << 8 & 0xFFFF) ^ _CRC_TABLE[r >> 8 ^ b]
    return r


def crc16_bits(protected: bytes, bits: int) -> int:
    """The checksum of so many leading bits."""
    r, rest = crc16(protected[: bits // 8]), bits % 8
    for k in range(rest):
        r = (r << 1 ^ (0x8005 if (r >> 15) ^ (protected[bits // 8] >> (7 - k) & 1) else 0)) & 0xFFFF
    return r


#: The writer's frames: MPEG 1 Layer III with CRC, 320 kbit/s, 32 kHz, mono.
FRAME = bytes((0xFF, 0xFA, 0xE8, 0xC0))
_HEAD = header(FRAME)
_SIDE = bytes(_HEAD.side)
_PREFIX = FRAME + crc16(FRAME[2:] + _SIDE).to_bytes(2, "big") + _SIDE
ROOM = _HEAD.size - len(_PREFIX)
OWNER = b"PRIV-payload-length\0"


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _from_syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def write(payload: bytes) -> bytes:
    """The stream that holds payload."""
    frames = -(-len(payload) // ROOM)
    private = OWNER + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    total = _HEAD.size * (frames + 1)
    xing = b"Info" + struct.pack(">III", 7, frames, total) + bytes(i * 256 // 100 for i in range(100))
    out = [b"ID3\4\0\0", _syncsafe(len(tag)), tag, (_PREFIX + xing).ljust(_HEAD.size, b"\0")]
    for i in range(0, len(payload), ROOM):
        out += (_PREFIX, payload[i : i + ROOM])
    out.append(bytes(frames * ROOM - len(payload)))
    return b"".join(out)


class Stream(NamedTuple):
    """What the reader finds. samples and hz give the exact duration; offsets are the frames' places in the bytes, tables left out."""

    samples: int
    hz: int
    offsets: list[int]
    bad_crc: int
    junk: int
    tags: list[str]
    table: str
    table_frames: int
    payload: bytes | None
    #: Seek points of the table: byte offsets of equal parts of the duration.
    points: list[int]

    @property
    def seconds(self) -> float:
        return self.samples / self.hz if self.hz else 0.0

    def seek(self, second: float) -> int | None:
        """The byte offset of the frame that plays at a second; None past the end."""
        n = int(second * self.hz) * len(self.offsets) // self.samples if self.samples else 0
        return self.offsets[n] if 0 <= n < len(self.offsets) else None


def vbr_table(frame: bytes, start: int) -> tuple[str, int, list[int]] | None:
    """A frame's variable-bitrate table: its name, the number of frames, and seek points as offsets from the frame; None where it holds none that fits it."""
    name = frame[start : start + 4]
    number = lambda at, size: int.from_bytes(frame[at : at + size], "big")
    if name in (b"Xing", b"Info") and start + 8 <= len(frame):
        flags, at = number(start + 4, 4), start + 8
        count = lambda bit, size: size if flags & bit else 0
        if at + count(1, 4) + count(2, 4) + count(4, 100) > len(frame):
            return None
        frames = number(at, 4) if flags & 1 else 0
        total = number(at + count(1, 4), 4) if flags & 2 else 0
        table = frame[at + count(1, 4) + count(2, 4) :][: count(4, 100)]
        return name.decode(), frames, [x * total // 256 for x in table] if total else []
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, size = number(54, 2), number(56, 2), number(58, 2)
        if size not in (1, 2, 3, 4) or 62 + entries * size > len(frame):
            return None
        points = [len(frame)]
        for k in range(entries):
            points.append(points[-1] + scale * number(62 + k * size, size))
        return "VBRI", number(50, 4), points[:-1] if entries else []
    return None


def read(data: bytes) -> Stream:
    """Parses a stream of any origin; damaged parts are skipped and counted."""
    pos = junk = bad = samples = hz = table_frames = 0
    tags, offsets, pieces, points, table, length, first = [], [], [], [], "", None, True
    end = len(data)
    while data[pos : pos + 3] == b"ID3" and pos + 10 <= end:
        size = _from_syncsafe(data[pos + 6 : pos + 10])
        tags.append(f"ID3v2.{data[pos + 3]}")
        at = data.find(OWNER, pos, pos + 10 + size)
        if at >= 0:
            length = int.from_bytes(data[at + len(OWNER) : at + len(OWNER) + 8], "big")
        pos += 10 + size
    locked: Header | None = None
    while pos < end:
        h = header(data[pos : pos + 4])
        ok = h is not None and pos + h.size <= end and (locked is None or (h.hz, h.layer) == (locked.hz, locked.layer))
        if ok and pos + h.size + 4 <= end:
            after = header(data[pos + h.size : pos + h.size + 4])
            # In step, a frame stands by itself; out of step, another must follow it.
            ok = locked is not None or (after is not None and (after.hz, after.layer) == (h.hz, h.layer))
        if not ok and pos == end - 128 and data[pos : pos + 3] == b"TAG":  # only where no frame reaches: a frame's data may hold these letters
            tags.append("ID3v1")
            break
        if not ok:
            locked = None
            m = _SYNC.search(data, pos + 1, end)
            junk += (m.start() if m else end) - pos
            pos = m.start() if m else end
            continue
        locked, hz = h, h.hz
        body = pos + 4 + 2 * h.crc
        if h.crc:
            # The count of what Layers I and II protect depends on the frame: at most 94 allocations of 4 bits, and 2 bits for 64.
            covered = data[body : min(pos + h.size, body + (h.side if h.layer == 3 else 64))]
            bits = min(protected_bits(h, covered), 8 * len(covered))
            bad += int.from_bytes(data[pos + 4 : pos + 6], "big") != crc16_bits(data[pos + 2 : pos + 4] + covered, 16 + bits)
        start = body + h.side
        known = vbr_table(data[pos : pos + h.size], start - pos) if first else None
        if known:
            table, table_frames, points = known[0], known[1], [pos + p for p in known[2]]
        else:
            offsets.append(pos)
            samples += h.samples
            if length is not None:
                pieces.append(data[start : pos + h.size])
        first = False
        pos += h.size
    payload = None if length is None else b"".join(pieces)[:length]
    return Stream(samples, hz, offsets, bad, junk, tags, table, table_frames, payload, points)


def padded(text: str) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of 64, and their count without."""
    raw = text.encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def stored(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the media column `media` (binary)."""
    return map_rows(df, lambda: lambda x: (write(padded(x)[0]),), "media binary", text)


def feature(s: Stream) -> str:
    """Exact duration (samples over rate), frame count, first and last seek offset, and what was wrong."""
    ends = f"{s.offsets[0]}-{s.offsets[-1]}" if s.offsets else "-"
    return f"samples={s.samples};hz={s.hz};frames={len(s.offsets)};offsets={ends};table={s.table}:{s.table_frames};tags={'+'.join(s.tags)};bad_crc={s.bad_crc};junk={s.junk}"


def parsed(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media column, with samples, hz, frame offsets and the counts of damage."""

    def make():
        def row(data) -> tuple:
            s = read(data or b"")
            return s.samples, s.hz, s.offsets, s.bad_crc, s.junk, s.tags, s.table, s.points

        return row

    return map_rows(df, make, "samples long, hz int, offsets array<long>, bad_crc long, junk long, tags array<string>, vbr_table string, table_points array<long>", media)


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with what the stored stream holds when read back."""

    def make():
        def row(x: str) -> tuple:
            payload, n = padded(x)
            media = write(payload)
            s = read(media)
            back = s.payload
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.offsets, s.points

        return row

    return map_rows(df, make, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>, table_points array<long>", text)


def op8_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
