"""Token ids by the tokenizers library, with its answers for words remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np

from .bpe import LONGEST, REMEMBERED_BYTES, Stretches, byte_symbols, entries_bytes
from .common import text_buffer

#: Groups of words that the library encodes at once: what it returns takes far more memory than their ids.
GROUPS = 64

# Kinds of bytes of a lower-case text. OTHER: of characters beyond ASCII that may be no letters.
_SPACE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = range(6)
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[:128] = _SIGN
_KIND[[*range(97, 123)]] = _LETTER
_KIND[[*range(48, 58)]] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[39] = _APOSTROPHE
_KIND[0xC2] = _OTHER
#: By kind of the byte before and of its own: whether a stretch begins. Words end there in any case; an apostrophe may form
#: a word with the letters that follow.
_BEGINS = np.zeros((6, 6), bool)
_BEGINS[_SPACE, _LETTER:] = True
_BEGINS[_LETTER, [_DIGIT, _SIGN, _APOSTROPHE]] = True
_BEGINS[_DIGIT, [_LETTER, _DIGIT, _SIGN, _APOSTROPHE]] = True
_BEGINS[_SIGN, [_LETTER, _DIGIT]] = True
_BEGINS[_APOSTROPHE, _DIGIT] = True
#: As tables for bytes.translate, which goes faster than an index array: kinds, and beginnings by own kind + 6 * the one before.
_KIND_TABLE, _BEGINS_TABLE = _KIND.tobytes(), _BEGINS.tobytes().ljust(256, b"\0")
_SPACE_CODES = bytes(range(_SPACE, 36, 6))
#: Stretches that may be several words.
_SEVERAL = re.compile(rb"['\xc2]|\xc3[\x97\xb7]").search


def stretches_of(column):
    """Stretches of an Arrow column of lower-case texts, each of one or more whole words, as a dictionary array of their
    bytes, and the number of stretches before each row. Bytes beyond ASCII are those of PLAIN."""
    import pyarrow as pa

    data, offsets = text_buffer(column)
    raw = data.tobytes()
    kind = np.frombuffer(bytearray(raw.translate(_KIND_TABLE)), np.uint8)
    if len(at := np.flatnonzero(data == 0xC2)):
        kind[at + 1] = _OTHER
    if len(at := np.flatnonzero(data == 0xC3)):
        at = at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]  # the signs for times and divided
        kind[at] = kind[at + 1] = _OTHER
    code = kind.copy()
    code[1:] += 6 * kind[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    code[first] = kind[first]  # as after white space
    code = code.tobytes()
    body = raw.translate(None, b"\t\n\v\f\r ")
    starts = np.flatnonzero(np.frombuffer(code.translate(_BEGINS_TABLE, _SPACE_CODES), bool))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(body)).astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
    return words, np.searchsorted(np.flatnonzero(np.frombuffer(code.translate(_BEGINS_TABLE), bool)), offsets)


class LibraryEncoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them, truncation and padding off.

    Where the vocabulary ends words by a suffix and drops white space, a text's ids are those of its words one after the
    other: the different stretches of a batch are told by vector operations, and those not met before are encoded by the
    library and remembered. Other vocabularies, and texts with characters whose normalization looks further, go to the
    library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if size <= 65_536 else np.int32)
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"]
        self.stretches = Stretches([t["content"] for t in spec.get("added_tokens", [])])
        # the same model for words that are split and mapped to their bytes' characters
        self.words = Tokenizer(BPE(vocab=spec["model"]["vocab"], merges=[(*m,) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], end_of_word_suffix=suffix, cache_capacity=0)) if self.by_word else None
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the latest stretches; as many older ones are remembered
        if self.by_word:
            self.words.pre_tokenizer = WhitespaceSplit()
            self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
            self.ends = np.zeros(size, bool)
            self.ends[[i for s, i in spec["model"]["vocab"].items() if s.endswith(suffix)]] = True
            self.symbols = np.array([*map(ord, byte_symbols())], "<u2")
            self.symbols[32] = 32  # between words
            other = self.stretches.other
            # bytes that need a look, and whether they with the next one tell a character that needs more than lower case
            self.suspect = bytes(bool(other(chr(b))) if b < 0x80 else b >= 0xC0 and b != 0xC3 for b in range(256))
            self.odd = np.ones((256, 256), bool)
            for c in map(chr, range(0x80, 0x180)):
                self.odd[(*c.encode(),)] = bool(other(c))

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different stretches by the library."""
        several = [c for c in new if _SEVERAL(c)]
        flat = [c for c in new if not _SEVERAL(c)] if several else new
        parts = [self.split.findall(c.decode()) for c in several]
        sizes, names = np.array([1] * len(flat) + [*map(len, parts)], np.int64), flat + several
        flat = flat + [w.encode() for w in chain.from_iterable(parts)]
        groups = [self.symbols[np.frombuffer(b" ".join(flat[i : i + 256]), np.uint8)].tobytes().decode("utf-16-le") for i in range(0, len(flat), 256)]
        lists = [np.array(e.ids, self.kind) for i in range(0, len(groups), GROUPS) for e in self.words.encode_batch_fast(groups[i : i + GROUPS], add_special_tokens=False)]
        ids = np.concatenate(lists) if lists else np.empty(0, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(flat):
            raise ValueError("the vocabulary doesn't end each word by its suffix")
        bounds = np.concatenate(([0], ends)) * self.kind.itemsize
        bounds, raw = bounds[np.concatenate(([0], np.cumsum(sizes)))].tolist(), ids.tobytes()
        return dict(zip(names, map(raw.__getitem__, map(slice, bounds, bounds[1:])), strict=True))

    def _ids_of(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of different stretches, as remembered or else from the library."""
        out = [*map(self.chunks.get, stretches)]
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        found = {(c := stretches[i]): self.older.get(c) for i in new}
        unseen = [c for c, ids in found.items() if ids is None]
        found |= self._learn(unseen)
        for i, ids in zip(new, found.values(), strict=True):
            out[i] = ids
        for c in [c for c in found if len(c) > LONGEST]:
            del found[c]
        size = entries_bytes(found)
        if size > REMEMBERED_BYTES:  # more than are held at all
            found = dict(islice(found.items(), len(found) * REMEMBERED_BYTES // size))
            size = entries_bytes(found)
        if self.held > REMEMBERED_BYTES:
            self.older, self.chunks, self.held = self.chunks, {}, 0
        self.chunks.update(found)
        self.held += size
        return out

    def _whole(self, column) -> np.ndarray:
        """Rows that go to the library whole."""
        import pyarrow.compute as pc

        data, offsets = text_buffer(column)
        at = np.flatnonzero(np.frombuffer(data.tobytes().translate(self.suspect), bool))
        at = at[self.odd[data[at], data[np.minimum(at + 1, len(data) - 1)]]]
        out = np.zeros(len(column), bool)
        out[np.searchsorted(offsets, at, side="right") - 1] = True
        for i in np.flatnonzero(pc.match_substring(column, self.stretches.begin).to_numpy(zero_copy_only=False)).tolist():
            out[i] |= bool(self.stretches.special(column[i].as_py()))
        return out

    def lists(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of an Arrow column of texts (none for null), one row after the other, and the number of ids before
        each row and after the last."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_word:
            return self._joined([np.array(e.ids, self.kind) for e in self.library.encode_batch(column.to_pylist(), add_special_tokens=False)])
        whole = self._whole(column)
        words, rows = stretches_of(pc.utf8_lower(pc.if_else(pa.array(whole), "", column) if whole.any() else column))
        if len(words):
            taken = pa.array(self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
            bounds = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[rows] // self.kind.itemsize
            ids = np.frombuffer(taken.buffers()[2], self.kind, int(bounds[-1]))
        else:
            ids, bounds = np.empty(0, self.kind), np.zeros(len(column) + 1, np.int64)
        if not whole.any():
            return ids, bounds
        return self._joined([np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, self.kind) if w else ids[bounds[i] : bounds[i + 1]] for i, w in enumerate(whole)])

    def _joined(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([*map(len, lists)], out=bounds[1:])
        return np.concatenate([np.empty(0, self.kind), *lists]), bounds

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        import pyarrow as pa

        ids, bounds = self.lists(pa.array(texts, pa.large_string()))
        return _cut(ids, bounds)

    def ended(self, column, end_id: int) -> list[np.ndarray]:
        """Ids of each row of an Arrow column of texts, and end_id behind them."""
        ids, bounds = self.lists(column)
        return _cut(np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds)))


def _cut(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    bounds = bounds.tolist()
    return [ids[a:z] for a, z in zip(bounds, bounds[1:])]


_loaded: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]
