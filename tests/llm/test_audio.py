"""The MPEG audio parser on streams built here, byte by byte, and not by the module's own writer."""

from fractions import Fraction

import pytest

from quantloom.llm import audio

VERSION = {"1": 3, "2": 2, "2.5": 0}


def crc(data):
    """CRC-16 of polynomial 0x8005, bit by bit."""
    x = 0xFFFF
    for b in data:
        for k in range(7, -1, -1):
            top = x >> 15 ^ b >> k & 1
            x = x << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return x


def frame(version, layer, bitrate_at, rate_at, size, *, mode=0, extension=0, padding=0, covered=None, body=b""):
    """A frame of `size` bytes (known from elsewhere); covered: under a checksum over so many bytes behind it."""
    head = bytes((0xFF, 0xE0 | VERSION[version] << 3 | 4 - layer << 1 | (covered is None), bitrate_at << 4 | rate_at << 2 | padding << 1, mode << 6 | extension << 4))
    rest = body + bytes((7 * i) % 251 for i in range(size - 4 - len(body) - (2 if covered is not None else 0)))
    check = b"" if covered is None else crc(head[2:] + rest[:covered]).to_bytes(2, "big")
    return head + check + rest


#: version, layer, bit rate and rate numbers, mode, size, samples, rate, kbit/s; sizes as encoders write them.
KINDS = [
    ("1", 3, 9, 0, 1, 417, 1152, 44_100, 128), ("1", 3, 5, 1, 3, 192, 1152, 48_000, 64), ("2", 3, 8, 0, 0, 208, 576, 22_050, 64), ("2.5", 3, 4, 2, 3, 288, 576, 8_000, 32),
    ("1", 2, 10, 1, 0, 576, 1152, 48_000, 192), ("2", 2, 8, 1, 0, 384, 1152, 24_000, 64), ("1", 1, 12, 0, 0, 416, 384, 44_100, 384), ("2", 1, 8, 2, 3, 384, 384, 16_000, 128),
]


@pytest.mark.parametrize("kind", KINDS)
def test_every_version_and_layer(kind):
    version, layer, b, r, mode, size, samples, rate, kbits = kind
    s = audio.parse(frame(version, layer, b, r, size, mode=mode) * 5)
    assert [at for at, _ in s.frames] == [0, size, 2 * size, 3 * size, 4 * size] and s.skipped == 0
    h = s.frames[0][1]
    assert (h.version, h.layer, h.bitrate, h.rate, h.samples, h.length) == (version, layer, kbits, rate, samples, size)
    assert s.samples == 5 * samples and s.duration() == Fraction(5 * samples, rate)
    assert f"mpeg{version}-layer{layer} {rate} Hz {audio.MODES[mode]}; kbit/s {kbits}; frames 5" in audio.feature(s, 5 * size)
    assert s.frame_at(0) == 0 and s.frame_at(Fraction(samples, rate)) == size and s.frame_at(10**6) == 4 * size


@pytest.mark.parametrize("version, layer, b, r, size, mode, extension, covered", [("1", 3, 9, 0, 417, 0, 0, 32), ("1", 3, 9, 0, 417, 3, 0, 17), ("2", 3, 8, 0, 208, 1, 2, 17), ("2", 3, 8, 0, 208, 3, 0, 9), ("1", 1, 12, 0, 416, 0, 0, 32), ("1", 1, 12, 0, 416, 3, 0, 16), ("1", 1, 12, 0, 416, 1, 1, 20)])
def test_checksums(version, layer, b, r, size, mode, extension, covered):
    good = frame(version, layer, b, r, size, mode=mode, extension=extension, covered=covered)
    assert audio.parse(good * 3).bad_checksums == 0
    bad = bytearray(good)
    bad[6 + covered - 1] ^= 1
    assert audio.parse(good + bytes(bad) + good).bad_checksums == 1
    bad[6 + covered - 1] ^= 1
    bad[6 + covered] ^= 1  # what the checksum doesn't cover
    assert audio.parse(good + bytes(bad) + good).bad_checksums == 0
    two = audio.parse(frame("1", 2, 10, 1, 576, covered=0) * 2)
    assert two.unverified == 2 and two.bad_checksums == 0


def test_padding_and_variable_rates():
    parts = [frame("1", 3, 9, 0, 418, padding=1), frame("1", 3, 5, 0, 208), frame("1", 3, 14, 0, 1044), frame("1", 3, 9, 0, 417)]
    s = audio.parse(b"".join(parts))
    assert [h.length for _, h in s.frames] == [len(p) for p in parts] and {h.bitrate for _, h in s.frames} == {128, 64, 320}


def test_resynchronisation():
    one = frame("1", 3, 9, 0, 417)
    junk = b"\xff\xfb\x90" + b"junk" * 20
    s = audio.parse(junk + one * 2 + junk + one * 2)
    assert len(s.frames) == 4 and s.skipped == 2 * len(junk)
    cut = audio.parse(one * 3 + one[:100])
    assert len(cut.frames) in (2, 3) and cut.skipped >= 100
    assert audio.parse(b"").frames == [] and audio.parse(b"\xff" * 99).skipped == 99


def sized(version, n):
    return bytes(n >> k & 127 for k in (21, 14, 7, 0)) if version == 4 else n.to_bytes(4, "big")


@pytest.mark.parametrize("version", [3, 4])
def test_tags_with_long_values(version):
    """In version 2.3 a frame's size is a plain number, in 2.4 it is in bytes of seven bits."""
    title = "t" * 300
    text = lambda name, raw: name + sized(version, len(raw)) + b"\0\0" + raw
    body = text(b"TIT2", b"\0" + title.encode()) + text(b"TPE1", b"\1" + "Ünï 中".encode("utf-16")) + text(b"APIC", b"\0" * 200) + text(b"TALB", b"\3" + "été".encode())
    tag = b"ID3" + bytes((version, 0, 0)) + sized(4, len(body) + 50) + body + bytes(50)
    s = audio.parse(tag + frame("1", 3, 9, 0, 417) * 2)
    assert s.tags == {"TIT2": title, "TPE1": "Ünï 中", "TALB": "été"} and s.frames[0][0] == len(tag) and s.skipped == 0


def test_old_tags_extended_header_and_unsynchronisation():
    body = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    assert audio.read_tag(b"ID3\x02\0\0" + sized(4, len(body)) + body)[0] == {"TT2": "abc"}
    frame_3 = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0\0a\xffc"
    extended = (6).to_bytes(4, "big") + bytes(6)
    raw = (extended + frame_3).replace(b"\xff", b"\xff\x00")
    assert audio.read_tag(b"ID3\x03\0\xc0" + sized(4, len(raw)) + raw) == ({"TIT2": "a\xffc"}, 10 + len(raw))
    end = b"TAG" + b"name".ljust(30, b"\0") + b"band".ljust(30) + bytes(65)
    s = audio.parse(frame("1", 3, 9, 0, 417) * 2 + end)
    assert s.tags == {"id3v1.title": "name", "id3v1.artist": "band"} and s.skipped == 0 and len(s.frames) == 2


def test_sound_that_spells_a_last_tag():
    body = bytes(417 - 4 - 128) + b"TAG"
    s = audio.parse(frame("1", 3, 9, 0, 417) + frame("1", 3, 9, 0, 417, body=body))
    assert len(s.frames) == 2 and s.tags == {}


def test_tables_of_variable_rates():
    vbri = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (1000).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (100).to_bytes(2, "big") + (200).to_bytes(2, "big")
    s = audio.parse(frame("1", 3, 9, 0, 417, mode=3, body=bytes(32) + vbri) + frame("1", 3, 9, 0, 417, mode=3) * 3)
    assert s.table == {"kind": "VBRI", "bytes": 1000, "frames": 3, "seek": [200, 600], "frames_a_point": 1} and len(s.frames) == 3 and s.samples == 3 * 1152
    xing = b"Xing" + (7).to_bytes(4, "big") + (2).to_bytes(4, "big") + (2560).to_bytes(4, "big") + bytes(range(100))
    s = audio.parse(frame("2", 3, 8, 0, 208, mode=3, body=bytes(9) + xing) + frame("2", 3, 8, 0, 208, mode=3) * 2)
    assert s.table == {"kind": "Xing", "frames": 2, "bytes": 2560, "seek": [10 * i for i in range(100)]} and "table Xing agrees" in audio.feature(s, 1)


def test_written_streams(odd):
    """What the writer makes, read by this file's own rules: sizes, checksums, main data."""
    for text in [*odd, "TAG" * 3000, "x" * 100_001]:
        pay = audio.padded((text or "").encode())
        media = audio.store(pay)
        at, got, frames = 10 + sum((media[6 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0))), [], 0
        while at < len(media):
            assert media[at] == 0xFF and media[at + 1] == 0xFA and media[at + 3] == 0xC0
            size = 144_000 * (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[(media[at + 2] >> 4) - 1] // 48_000
            assert crc(media[at + 2 : at + 4] + media[at + 6 : at + 23]) == int.from_bytes(media[at + 4 : at + 6], "big")
            got.append(media[at + 23 : at + size])
            at, frames = at + size, frames + 1
        assert got[0][:4] == b"Xing" and int.from_bytes(got[0][8:12], "big") == frames - 1
        assert b"".join(got[1:])[: len(pay)] == pay
        s = audio.parse(media)
        assert audio.payload_of(media, s) == pay and s.bad_checksums == s.skipped == 0
