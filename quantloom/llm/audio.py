"""Operator 5, media columns: MPEG audio.

The parser takes MPEG-1, MPEG-2 and MPEG-2.5 streams of layers I, II and III. It finds frames by their headers, steps from
each to the next by its length, and where a header is broken looks for the next place at which two headers in a row agree.
It reads tags (ID3v2.2 to 2.4, ID3v1) and the table for variable bit rates (Xing, Info, VBRI), verifies each frame's
checksum (layer I: header and bit allocation; layer III: header and side information; what a layer II checksum covers
depends on allocation tables and is not verified, such frames are counted), and gives exact durations and each frame's offset.

The writer makes a tag, a frame with a Xing table and layer III frames under CRC-16. A payload of bytes is stored
losslessly as the frames' main data; a tag entry holds its length, since frames are whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, slices

# Fixed values of the format (ISO/IEC 11172-3, 13818-3): bit rates in kbit/s by MPEG-1 or not and layer, sample rates.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44_100, 48_000, 32_000), "2": (22_050, 24_000, 16_000), "2.5": (11_025, 12_000, 8_000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
MODES = ("stereo", "joint stereo", "dual channel", "mono")

HEAD = 4
CRC = 2
#: What this module writes: MPEG-1 layer III, 48 kHz mono, padding off; the bit rate varies with what is left to store.
RATE_AT, RATE = 1, 48_000
SIDE = 17
FIRST_DATA = HEAD + CRC + SIDE
UNIT = 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = ((x << 1) ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    x = start
    for b in data:
        x = ((x << 8) & 0xFFFF) ^ _CRC[(x >> 8) ^ b]
    return x


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != "1" else 1152

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12_000 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.bitrate // self.rate + self.padding

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def data_at(self) -> int:
        return HEAD + CRC * self.protected

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)

    @property
    def covered(self) -> int | None:
        """Bytes behind the checksum that it covers; None where that takes allocation tables."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:  # four bits a subband and channel; above the bound of joint stereo channels share them
            bound = 4 * (self.extension + 1) if self.mode == 1 else 32
            return 16 if self.mono else (2 * bound + 32 - bound) // 2
        return None

    def agrees(self, other: Header | None) -> bool:
        return other is not None and (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def header_at(data: bytes, at: int) -> Header | None:
    """A valid header with a stated bit rate, or None."""
    if at < 0 or at + HEAD > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    a, b, c = data[at + 1], data[at + 2], data[at + 3]
    version, layer, bitrate, rate = VERSIONS.get(a >> 3 & 3), 4 - (a >> 1 & 3), b >> 4, b >> 2 & 3
    if version is None or layer == 4 or not 0 < bitrate < 15 or rate == 3 or c & 3 == 2:
        return None
    return Header(version, layer, not a & 1, BITRATES[version == "1", layer][bitrate - 1], SAMPLE_RATES[version][rate], b >> 1 & 1, c >> 6, c >> 4 & 3)


def _head(bitrate_at: int) -> bytes:
    return bytes((0xFF, 0xFA, bitrate_at << 4 | RATE_AT << 2, 0xC0))


#: (bytes of main data, header and checksum and side information) of each bit rate.
_FORMS = []
for _k in range(1, 15):
    _raw = _head(_k)
    _FORMS.append((144_000 * BITRATES[True, 3][_k - 1] // RATE - FIRST_DATA, _raw + crc16(_raw[2:4] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)))


def _safe(n: int) -> bytes:
    """28 bits in four bytes of seven."""
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def store(payload: bytes) -> bytes:
    """The stream that holds a payload."""
    best, form = _FORMS[-1]
    frames = [form + payload[a : a + best] for a in range(0, len(payload) - best + 1, best)] if len(payload) >= best else []
    rest = payload[len(frames) * best :]
    if rest:
        room, form = next(f for f in _FORMS if f[0] >= len(rest))
        frames.append(form + rest + bytes(room - len(rest)))
    sizes = [len(f) for f in frames]
    note = b"\0payload\0" + str(len(payload)).encode()
    tag_frame = b"TXXX" + _safe(len(note)) + b"\0\0" + note
    tag = b"ID3\x04\0\0" + _safe(len(tag_frame)) + tag_frame
    room, form = _FORMS[5]
    total = len(form) + room + sum(sizes)
    ends = np.cumsum([len(form) + room, *sizes])
    seek = bytes(min(255, int(ends[i * (len(ends) - 1) // 100]) * 256 // total) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    return b"".join((tag, form, table + bytes(room - len(table)), *frames))


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    frames: list[tuple[int, Header]] = field(default_factory=list)  # offset in the bytes, header; without the table's frame
    bad_checksums: int = 0
    unverified: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    def duration(self) -> Fraction:
        """Seconds, exactly."""
        by_rate: dict[int, int] = {}
        for _, h in self.frames:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))

    def frame_at(self, seconds: float | Fraction) -> int:
        """The offset of the frame that sounds then; the first or last one for times before or behind the stream."""
        if not self.frames:
            raise ValueError("no frames")
        starts, now = [], Fraction(0)
        for _, h in self.frames:
            starts.append(now)
            now += Fraction(h.samples, h.rate)
        return self.frames[max(bisect_right(starts, Fraction(seconds)) - 1, 0)][0]


def _syncsafe(raw: bytes) -> int:
    """A number in bytes of seven bits."""
    n = 0
    for b in raw:
        n = n << 7 | b & 127
    return n


def _text(raw: bytes) -> str:
    """A text frame's body: one byte names the encoding; values end at zeros."""
    if not raw:
        return ""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[raw[0]] if raw[0] < 4 else "latin-1"
    return raw[1:].decode(kind, "replace").rstrip("\0")


def read_tag(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of an ID3v2 tag at the beginning, and where it ends (0: there is none)."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    body, end = data[10 : 10 + size], 10 + size + (10 if version == 4 and flags & 0x10 else 0)
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    k, wide, tags = 0, 3 if version == 2 else 4, {}
    if flags & 0x40 and version > 2:  # an extended header: its size counts itself in version 4 only
        k = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if version == 2 else 10
    while k + head <= len(body) and body[k] != 0:
        name, raw = body[k : k + wide].decode("latin-1"), body[k + wide : k + 2 * wide]
        length = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        value, marks = body[k + head : k + head + length], body[k + head - 1] if version > 2 else 0
        if version == 4 and marks & 0x02:
            value = value.replace(b"\xff\x00", b"\xff")
        if name.startswith("T"):
            text = _text(value)
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            tags[name] = text
        k += head + length
    return tags, min(end, len(data))


def _rate_table(data: bytes, at: int, h: Header) -> dict | None:
    """The table of variable bit rates in a frame: frames, bytes and seek points as the table has them."""
    k = at + h.data_at + h.side
    if h.layer == 3 and data[k : k + 4] in (b"Xing", b"Info"):
        out: dict = {"kind": data[k : k + 4].decode()}
        flags, k = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[k : k + 4], "big")
                k += 4
        if flags & 4:
            out["seek"] = [x * out["bytes"] // 256 for x in data[k : k + 100]] if "bytes" in out else list(data[k : k + 100])
        return out
    k = at + HEAD + 32
    if h.layer == 3 and data[k : k + 4] == b"VBRI":
        number = lambda a, n: int.from_bytes(data[k + a : k + a + n], "big")
        entries, scale, wide = number(18, 2), number(20, 2), number(22, 2)
        sums = np.cumsum([number(26 + i * wide, wide) * scale for i in range(entries)]) if entries else []
        return {"kind": "VBRI", "bytes": number(10, 4), "frames": number(14, 4), "seek": [int(x) for x in sums], "frames_a_point": number(24, 2)}
    return None


def parse(data: bytes) -> Stream:
    """Tags, table and frames of a stream; broken stretches are skipped and counted. Bytes without frames give none."""
    out, n = Stream(), len(data)
    out.tags, at = read_tag(data)
    last = lambda k: n - k == 128 and data[k : k + 3] == b"TAG"  # noqa: E731  frames go before it: sound may hold these letters
    first, before = True, None  # before: the header of the frame that ends here
    while at + HEAD <= n:
        h = header_at(data, at)
        z = at + h.length if h is not None else 0
        if h is None or h.length < h.data_at or z > n or not (h.agrees(before) or z == n or last(z) or h.agrees(header_at(data, z))):
            before = None
            if last(at):
                for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
                    if value := data[at + a : at + b].split(b"\0")[0].rstrip(b" ").decode("latin-1"):
                        out.tags.setdefault(f"id3v1.{name}", value)
                return out
            nxt = data.find(b"\xff", at + 1)  # resynchronise at the next byte that may begin a header, or at the last tag
            nxt = n - 128 if at < n - 128 and last(n - 128) and not 0 <= nxt < n - 128 else nxt
            out.skipped += (nxt if nxt >= 0 else n) - at
            if nxt < 0:
                return out
            at = nxt
            continue
        if h.protected:
            covered = h.covered
            if covered is None:
                out.unverified += 1
            elif crc16(data[at + 2 : at + 4] + data[at + HEAD + CRC : at + HEAD + CRC + covered]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.bad_checksums += 1
        table = _rate_table(data, at, h) if first else None
        if table is not None:
            out.table = table
        else:
            out.frames.append((at, h))
        first, before, at = False, h, z
    out.skipped += max(n - at, 0)
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    whole = b"".join(data[at + h.data_at + (h.side if h.layer == 3 else 0) : at + h.length] for at, h in stream.frames)
    return whole[: int(stream.tags.get("payload", len(whole)))]


def feature(stream: Stream, size: int) -> str:
    """What the columns say of a stream, as one string; format, rate and channels are those of its frames."""
    kinds = sorted({f"mpeg{h.version}-layer{h.layer} {h.rate} Hz {MODES[h.mode]}" for _, h in stream.frames})
    rates = sorted({h.bitrate for _, h in stream.frames})
    seek = zlib.crc32(np.array([at for at, _ in stream.frames], "<u8").tobytes())
    table = "none" if stream.table is None else f"{stream.table['kind']} {'agrees' if stream.table.get('frames') == len(stream.frames) else 'differs'}"
    return f"{' + '.join(kinds) or 'no frames'}; kbit/s {','.join(map(str, rates))}; frames {len(stream.frames)}; samples {stream.samples}; bytes {size}; table {table}; bad {stream.bad_checksums}; unverified {stream.unverified}; skipped {stream.skipped}; seek {seek:08x}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(UNIT - len(raw) if not raw else -len(raw) % UNIT)


def store_texts(df: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes of the text in UTF-8 (null: none) and media, the stream that holds the padded bytes.

    Texts of any length are taken whole. Repeated rows give equal values; an empty df gives no rows. Other columns are
    left out, and a keep column named like a result gives way to it.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    kept = [c for c in keep if c not in ("media", "n_bytes", "__text")]
    base = df.select(*kept, F.col(text).alias("__text"))

    def run(batches):
        for big in batches:
            for batch in slices(big, "__text"):
                raw = [(t or "").encode() for t in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], [*kept, "n_bytes", "media"])

    return base.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


STREAM = [T.StructField("samples", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("bad_checksums", T.LongType()), T.StructField("skipped_bytes", T.LongType()), T.StructField("seek_offsets", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]


def parse_media(df: DataFrame, *, media: str = "media") -> DataFrame:
    """df with what the parser finds in each stream: samples, seconds, bad_checksums, skipped_bytes, seek_offsets, payload, feature.

    A null stream is parsed as no bytes: no frames, an empty payload. Columns of these names are replaced. Repeated rows
    give equal values; an empty df gives no rows; long streams are parsed one at a time.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    base = df.drop(*[f.name for f in STREAM])

    def run(batches):
        for big in batches:
            for batch in slices(big, media):
                data = [x or b"" for x in batch.column(media).to_pylist()]
                found = [parse(x) for x in data]
                yield pa.RecordBatch.from_arrays([
                    *batch.columns, pa.array([s.samples for s in found], pa.int64()), pa.array([float(s.duration()) for s in found], pa.float64()), pa.array([s.bad_checksums for s in found], pa.int64()), pa.array([s.skipped for s in found], pa.int64()),
                    pa.array([[a for a, _ in s.frames] for s in found], pa.list_(pa.int64())), pa.array([payload_of(x, s) for x, s in zip(data, found, strict=True)], pa.binary()), pa.array([feature(s, len(x)) for x, s in zip(data, found, strict=True)], pa.string()),
                ], [*batch.schema.names, *[f.name for f in STREAM]])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *STREAM]))
