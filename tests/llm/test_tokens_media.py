"""Operators 1, 4, 5 and 7 against the tokenizers library, round trips and brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
from quantloom.llm import audio, bpe, packing, queries, token_store, tokens
from quantloom.llm.tokens import LibraryEncoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_op1_is_the_library(spark, docs, folder, library):
    texts = texts_of(docs)
    got = {r.doc_id: r for r in queries.op1_bpe_roundtrip(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_backtracking_is_merging(library):
    b, rng = bpe.WordBPE(queries.vocabulary()), random.Random(3)
    for _ in range(1500):
        w = "".join(rng.choice("thernaoisdlé'0") for _ in range(rng.randint(1, 25)))
        symbols = w.encode().decode("latin-1").translate(b.code) + bpe.MARK
        assert b.word(symbols) == b.by_merging(symbols)
    assert all(b.self_made(t) for t in b.parts)


def test_encoders_on_every_character(library):
    b, lib = bpe.WordBPE(queries.vocabulary()), LibraryEncoder(queries.vocabulary())
    texts = [f"a{chr(c)}b, {chr(c)}. {chr(c)}," for c in itertools.chain(range(1, 0x250), range(0x370, 0x400))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in b.encode(texts)] == want
    assert [x.tolist() for x in lib.encode(texts)] == want


def test_op4_reads_back(spark, docs, folder, library):
    got = {r.doc_id: r for r in queries.op4_token_store(spark, folder).collect()}
    start = 0
    for k, t in sorted(texts_of(docs).items(), key=lambda x: (x[0] is not None, x[0])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_block_access_and_dictionary():
    lists = [np.arange(n, dtype=np.uint16) for n in (1, 50, 3, 900)] * 5
    d = token_store.train_dictionary([x.tobytes() for x in lists] * 20)
    raw = token_store.pack_block([*enumerate(lists[:-1]), (None, lists[-1])], d, 7)
    b = token_store.Block(raw, d)
    assert b.before == 7 and b.n == len(lists) and b.name(len(lists) - 1) is None
    for i in (13, 0, 19):
        assert (b.ids(i) == lists[i]).all()
    if d:
        with pytest.raises(ValueError, match="another dictionary"):
            token_store.Block(raw, b"")
    with pytest.raises(ValueError, match="not a block"):
        token_store.Block(b"x" * 80, d)


def test_op5(spark, docs, folder):
    texts = texts_of(docs)
    got = {r.doc_id: r for r in queries.op5_mpeg_audio(spark, folder).collect()}
    for k, t in texts.items():
        raw = t.encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        media = audio.store(pay)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.bad_checksums == r.skipped_bytes == 0 and r.feature.startswith("mpeg1-layer3 48000 Hz mono; ") and "table Xing agrees" in r.feature
        assert r.samples == 1152 * len(r.seek_offsets) and r.seconds == pytest.approx(r.samples / 48_000)


def test_parser_resynchronises_and_verifies():
    pay = random.Random(5).randbytes(20_000)
    media = audio.store(pay)
    s = audio.parse(media)
    assert audio.payload_of(media, s) == pay and s.table["frames"] == len(s.frames) and s.table["bytes"] == len(media) - len(media[: media.index(b"\xff\xfa")])
    assert float(s.duration()) == pytest.approx(len(s.frames) * 1152 / 48_000) and s.frame_at(0.03) == s.frames[1][0]
    broken = bytearray(media)
    broken[s.frames[3][0]] = 0  # a header is lost: its frame is skipped, the next is found
    t = audio.parse(bytes(broken))
    assert t.skipped > 0 and s.frames[4:] == t.frames[-len(s.frames[4:]) :]
    broken = bytearray(media)
    broken[s.frames[2][0] + 8] ^= 1  # in the side information
    assert audio.parse(bytes(broken)).bad_checksums == 1
    assert audio.parse(b"").frames == [] and audio.parse(b"\xff" * 50).frames == []
    tail = b"TAG" + b"name".ljust(125, b"\0")
    assert audio.parse(media + tail).tags["id3v1.title"] == "name"


def brute_cuts(places, costs, size):
    p, best = [0, *places], [0]
    for j in range(1, len(p)):
        best.append(min(best[i] + size - (p[j] - p[i]) + costs[j - 1] for i in range(j) if p[j] - p[i] <= size))
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(5, 40)
        places = np.cumsum([rng.randint(1, size) for _ in range(rng.randint(1, 60))])
        costs = np.array([rng.choice([0, 3, 20]) for _ in places])
        cuts = packing.best_cuts(places, costs, size)
        ends = [0, *places[cuts].tolist()]
        assert cuts[-1] == len(places) - 1 and all(0 < b - a <= size for a, b in zip(ends, ends[1:]))
        assert sum(size - (b - a) for a, b in zip(ends, ends[1:])) + int(costs[cuts].sum()) == brute_cuts(places.tolist(), costs.tolist(), size)


def test_op7_each_id_once(spark, docs, folder, library):
    texts = texts_of(docs)
    rows = queries.op7_packing(spark, folder).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, t in texts.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


def test_packer_over_many_runs(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 500)
    rng = random.Random(9)
    ends = np.zeros(1 << 16, bool)
    ends[7] = True
    p, docs, pieces = packing.Packer(ends, 64), [np.array([rng.randrange(50) for _ in range(rng.randint(1, 200))], np.uint16) for _ in range(80)], []
    for i, d in enumerate(docs):
        pieces += p.add(i, d)
    pieces += p.finish()
    windows, at = {}, {}
    for name, start, length, crc, total, window, offset in pieces:
        assert start == at.get(name, 0) and offset == windows.get(window, 0) and total == len(docs[name])
        assert crc == zlib.crc32(docs[name][start : start + length].astype("<u4"))
        at[name], windows[window] = start + length, offset + length
    assert at == {i: len(d) for i, d in enumerate(docs)} and max(windows.values()) <= 64 and sorted(windows) == list(range(len(windows)))


@pytest.mark.parametrize("name", ["op1_bpe_roundtrip", "op4_token_store", "op5_mpeg_audio", "op7_packing", "op9_shard_lookup"])
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).collect() == []


def test_what_is_remembered_is_counted_at_once(library):
    """Remembered stretches are counted together; known ones are left alone; signs that need more than lower case are told."""
    texts = ["Some words, and some more words. 12,5 naïve", "some words, x" + "y" * 300, "", "more words <| and <|endoftext|> here", "more <|words"]
    lib = LibraryEncoder(queries.vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in lib.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert lib.held == bpe.entries_bytes(lib.chunks) == sum(bpe.entry_bytes(*x) for x in lib.chunks.items()) > 0
    plain = {chr(c) for c in (*range(9, 14), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x149), *range(0x14A, 0x180))}
    for c in map(chr, (*range(0x250), 0x3A3, 0x2028, 0x1F600)):
        assert (lib.stretches(f"a{c}b") is not None) == (c in plain)


def test_stretches_are_told_by_vectors_and_as_the_library_splits(library, monkeypatch):
    """Odd signs, contractions, digits, signs beyond ASCII, nulls and slices; the different stretches of a batch are looked up
    once, not each time they stand in it."""
    rng, lib = random.Random(5), LibraryEncoder(queries.vocabulary())
    parts = ["'s", "'LL", "'", "it", "Über", "ÿŸ", "12", "!", ",.", "«", "²", "ª", "×", "÷", "Ñ", " ", "\n", "\t ", "<|", "endoftext|>", "é", "\u0130", "z" * 300, "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2_000)]
    column = pa.chunked_array([pa.array(["cut off", None, *texts])]).combine_chunks().slice(1)
    want = [[], *(e.ids for e in library.encode_batch(texts, add_special_tokens=False))]
    for _ in range(2):
        ids, bounds = lib.lists(column)
        assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == want
        assert [x.tolist() for x in lib.ended(column, 2)] == [[*x, 2] for x in want]
    assert lib.lists(column.slice(0, 0))[1].tolist() == [0]
    assert [x.tolist() for x in lib.encode(["", None, " \n"])] == [[], [], []]
    asked = []
    monkeypatch.setattr(lib, "_ids_of", lambda found, own=lib._ids_of: asked.append(len(found)) or own(found))
    lib.encode(["it was, it is: it's 11"] * 1_000)
    assert asked == [7]  # it, was, a comma, is, a colon, 's, 1


def test_few_are_remembered(library, monkeypatch):
    """More different stretches than may be held, in one batch and in many."""
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 5_000)
    rng, lib = random.Random(6), LibraryEncoder(queries.vocabulary())
    for n in (200, 5, 1, 30, 5, 400, 5):
        texts = [" ".join(rng.choice("aeiou") * rng.randint(1, 3) + rng.choice("bcdfg") for _ in range(20)) for _ in range(n)]
        assert [x.tolist() for x in lib.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert lib.held == bpe.entries_bytes(lib.chunks) <= 10_000 and bpe.entries_bytes(lib.older) <= 10_000


def test_packing_prepares_once_and_encodes_batches(spark, docs, folder, monkeypatch):
    """Sentence ends of a vocabulary are worked out once in a worker; windows are those of the library's own id lists."""
    ends = packing.sentence_ends(queries.vocabulary())
    assert ends is packing.sentence_ends(queries.vocabulary()) and ends.any() and not ends.flags.writeable
    texts = texts_of(docs)
    got = sorted(map(tuple, packing.pack_documents(docs, queries.vocabulary(), parts=1).collect()), key=lambda r: (r[5], r[6]))
    lib, packer, want = LibraryEncoder(queries.vocabulary()).library, packing.Packer(ends), []
    for k in sorted(texts, key=lambda x: (x is not None, x)):
        want += packer.add(k, np.array([*lib.encode(texts[k], add_special_tokens=False).ids, 1], np.uint16))
    want += packer.finish()
    assert got == [tuple(r) for r in want]
