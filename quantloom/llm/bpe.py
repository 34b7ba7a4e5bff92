"""Operator 1, BPE encoding and decoding.

Encoding: an Aho-Corasick automaton over the vocabulary, run once over a word, lists the tokens that begin at each
place, longest first. The encoder takes the longest one whose pair with the token before it is compatible, and steps
back where none is; places that were found to lead nowhere are marked, so no place is entered twice and a word of n
characters takes time linear in n. Two tokens are compatible if merging their joined characters gives these two again,
which the pair table answers from the merge order alone. The result is that of the merges.

Decoding: the tokens' strings lie in one block; an offset table cuts them out, for all ids of a batch at once.

The vocabulary file (a parameter) is that of a word-level BPE: lower case, white space dropped, words ended by a suffix.
Texts with characters for which normalization does more than lower the case, or with the strings of special tokens, go
through the vocabulary file's own normalizer and splitter before the same encoder.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, slices

#: Stands for the suffix that ends words, as one character that no byte maps to.
MARK = "￿"
#: Encoded stretches of text, and words, are remembered up to about so many bytes each in a Python worker; those of more
#: characters than LONGEST (runs without white space, hardly ever met again) are not.
REMEMBERED_BYTES = 64 << 20
LONGEST = 256
#: Latin letters and marks for which lower case is all that normalization does, and white space that all agree on.
PLAIN = r"\x09-\x0d\x20-\x7e¡-¬®-įĲ-ňŊ-ſ"


#: A stop or comma behind another sign, with which it forms one run.
RUN = r"[!-/:-@\[-`{-~¡-¿×÷][.,]"


class Stretches:
    """Cuts a text whose normalization is lower case alone into stretches between white space.

    Stops and commas that end a word are cut off it, so that fewer different stretches come up; they are runs of their
    own anyway.
    """

    def __init__(self, special: Sequence[str]):
        self.other = re.compile(f"[^{PLAIN}]").search
        self.run = re.compile(RUN).search
        self.begin = os.path.commonprefix([*special])  # a plain search for it, which goes faster, comes first
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)").search

    def __call__(self, text: str) -> list[str] | None:
        """None where the text needs full normalization."""
        if self.other(text) or self.begin in text and self.special(text):
            return None
        text = text.lower()
        if not self.run(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.split()


def byte_symbols() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Chunks(dict):
    """Ids of stretches of text, encoded when first asked for; forget() once in a while bounds what is held."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(text) <= LONGEST:
            self[text] = ids
            self.held += entry_bytes(text, ids)
        return ids

    def forget(self) -> None:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0


def entry_bytes(text: str, ids: bytes) -> int:
    """About what a remembered entry takes, at the most."""
    return 4 * len(text) + len(ids) + 240


def entries_bytes(entries: dict[str, bytes]) -> int:
    """The same for all of them together."""
    return 4 * sum(map(len, entries)) + sum(map(len, entries.values())) + 240 * len(entries)


class WordBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.stretches = Stretches([*self.special])
        self.symbols = byte_symbols()
        self.code = str.maketrans({bytes([b]).decode("latin-1"): s for b, s in enumerate(self.symbols)})

        def own(s: str) -> str:
            return s[: -len(suffix)] + MARK if s.endswith(suffix) and len(s) > len(suffix) else s

        self.ids = {own(s): i for s, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = own(a), own(b)
            pair = (self.ids[a], self.ids[b])
            token = self.ids[a + b]
            self.rank[pair], self.merged[pair] = rank, token
            self.parts.setdefault(token, pair)
        self.order = {t: self.rank[p] for t, p in self.parts.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.length = {i: len(s) for s, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if s != MARK:
                self.automaton.add_word(s[::-1], (i, len(s)))  # matches that end at a place of the reversed word begin there in the word
        self.automaton.make_automaton()
        self.chunks, self.known_words = _Chunks(self.chunk), _Chunks(self.plain_word)
        self.library = Tokenizer.from_file(path)
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        raw = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.kind = np.uint16 if len(raw) <= 65_536 else np.int32
        self.block = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=self.offsets[1:])

    # ---- encoding

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b as they are when they stand side by side."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the merges of both sides, latest first: a merge across the border that comes earlier would have been made instead."""
        limit = len(self.rank)
        while True:
            over = self.rank.get((a, b))
            if over is not None and over < limit:
                return False
            left, right = self.order.get(a, -1), self.order.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:  # a's last merge came later; while it wasn't made, its right part stood at the border
                limit, a = left, self.parts[a][1]
                # at equal rank the left one is made first, so the border pair must be strictly earlier
            else:
                limit, b = right + 1, self.parts[b][0]

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as its bytes' characters with MARK behind the last."""
        n = len(symbols)
        whole = self.ids.get(symbols)
        if whole is not None and self.self_made(whole):
            return [whole]
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(symbols[::-1]):
            at = n - 1 - end
            if at + size <= n:
                starts[at].append(token)
        out: list[int] = []
        tried = [0]  # for each token in out, and the next one, how many candidates of its place are used up
        dead = bytearray(n + 1)
        at = 0
        length, compatible = self.length, self.compatible
        while at < n:
            options, k = starts[at], tried[-1]
            if k < len(options):
                tried[-1] = k + 1
                token = options[k]
                after = at + length[token]
                if not dead[after] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    tried.append(0)
                    at = after
            else:
                dead[at] = 1
                tried.pop()
                if not out:
                    return self.by_merging(symbols)  # a vocabulary in which some token isn't made by its own merges
                at -= length[out.pop()]
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019  one instance lives as long as its worker
    def self_made(self, token: int) -> bool:
        """Whether merging a token's own characters gives this token."""
        pair = self.parts.get(token)
        return pair is None or (self.self_made(pair[0]) and self.self_made(pair[1]) and self.compatible_within(*pair))

    def compatible_within(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before the one that joins a and b."""
        limit = self.rank[(a, b)]
        while True:
            left, right = self.order.get(a, -1), self.order.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                a, last = self.parts[a][1], left
            else:
                b, last = self.parts[b][0], right + 1
            over = self.rank.get((a, b))
            if over is not None and over < min(last, limit):
                return False

    def by_merging(self, symbols: str) -> list[int]:
        """The merges, one by one: earliest rank first, leftmost among equals."""
        out = [*symbols[:-2], symbols[-2:]] if symbols.endswith(MARK) else [*symbols]
        ids = [self.ids[x] for x in out if x in self.ids]
        while len(ids) > 1:
            rank, i = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == len(self.rank):
                break
            pair, done, k = (ids[i], ids[i + 1]), [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    done.append(self.merged[pair])
                    k += 2
                else:
                    done.append(ids[k])
                    k += 1
            ids = done
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a normalized stretch without white space, as bytes."""
        found = self.words.findall(text)
        self.known_words.forget()
        return b"".join(map(self.known_words.__getitem__, found))

    def plain_word(self, text: str) -> bytes:
        symbols = text if text.isascii() else text.encode().decode("latin-1").translate(self.code)
        return np.array(self.word(symbols + MARK), self.kind).tobytes()

    def in_full(self, text: str) -> bytes:
        """Ids of any text: the library's own normalizer and splitter go before the encoder, special tokens stand apart."""
        out = []
        for i, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.extend(self.word(symbols + MARK))
        return np.array(out, self.kind).tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        known, out = self.chunks, []
        for text in texts:
            split = self.stretches(text) if text else ()
            if split is None:
                ids = self.in_full(text)
            else:
                ids = b"".join(map(known.__getitem__, split))
                known.forget()
            out.append(np.frombuffer(ids, self.kind))
        return out

    # ---- decoding

    def decode(self, ids: np.ndarray, bounds: Sequence[int]) -> tuple[bytes, np.ndarray]:
        """Texts of the id lists ids[bounds[i]:bounds[i+1]], joined, and their offsets: tokens' strings with a space between."""
        ids = np.asarray(ids, np.int64)
        bounds = np.asarray(bounds, np.int64)
        last = np.zeros(len(ids), np.int64)
        ends = bounds[1:][bounds[1:] > bounds[:-1]]
        last[ends - 1] = 1
        size = self.offsets[ids + 1] - self.offsets[ids]
        to = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size + 1 - last, out=to[1:])
        whole = np.full(int(to[-1]), 32, np.uint8)
        source = np.repeat(self.offsets[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        place = np.repeat(to[:-1] - (np.cumsum(size) - size), size) + np.arange(len(source))
        whole[place] = self.block[source]
        return whole.tobytes(), to[bounds]


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encoded_lists(bpe: WordBPE, column):
    """The id lists of an Arrow column of texts; empty for null."""
    import pyarrow as pa

    lists = bpe.encode(column.to_pylist())
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)))


def encode_documents(df: DataFrame, vocabulary: str, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns and `ids`, the token ids of each whole text (array of int; empty for a null or empty text).

    No shuffle: each batch of rows is encoded where it was read, texts of any length whole. Repeated rows are encoded
    alike, an empty df gives no rows; a keep column named like the text or `ids` is left out, as are all others.
    """
    ship(df.sparkSession)
    kept = [c for c in keep if c not in ("ids", "__text")]
    base = df.select(*kept, F.col(text).alias("__text"))

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(vocabulary)
        for big in batches:
            for batch in slices(big, "__text"):
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], encoded_lists(bpe, batch.column("__text"))], [*kept, "ids"])

    return base.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded_lists(bpe: WordBPE, column):
    """The texts of an Arrow column of id lists; null for null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    bounds = np.asarray(column.offsets, np.int64)
    block, offsets = bpe.decode(np.asarray(column.values)[bounds[0] : bounds[-1]], bounds - bounds[0])
    texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(block)])
    return (pc.if_else(column.is_valid(), texts, None) if column.null_count else texts).cast(pa.string())


def decode_documents(df: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the text of each id list; null for null, empty for an empty one. A column of that name is replaced.

    Lists of any length are decoded whole, a bounded number of ids at a time or one list; repeated rows are decoded
    alike, and an empty df gives no rows.
    """
    ship(df.sparkSession)
    base = df.drop("decoded")

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(vocabulary)
        for big in batches:
            for batch in slices(big, ids):
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded_lists(bpe, batch.column(ids))], [*batch.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(df: DataFrame, vocabulary: str, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns, `ids` and `decoded` of each whole text: encode_documents and decode_documents in one pass, so that the
    ids go through Arrow once. Nulls, odd rows and clashing columns are as there."""
    ship(df.sparkSession)
    kept = [c for c in keep if c not in ("ids", "decoded", "__text")]
    base = df.select(*kept, F.col(text).alias("__text"))

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(vocabulary)
        for big in batches:
            for batch in slices(big, "__text"):
                ids = encoded_lists(bpe, batch.column("__text"))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids, decoded_lists(bpe, ids)], [*kept, "ids", "decoded"])

    return base.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
