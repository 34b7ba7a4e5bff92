"""Operator 13, fill-in-the-middle: a distinct-text index with Elias-Fano boundary lists.

1. Identical texts are grouped by their content: the grouping compares whole texts (digests only say where a group is
   dealt), so no two different texts share an entry. A group carries the ids of its documents.
2. For each entry the ends of its tokens, an ascending list, are stored in Elias-Fano form: low bits as they are, high bits
   as gaps in unary, about 2 + log2(characters / tokens) bits a token.
3. The documents are joined back to their entry through the ids that it carries. Each document's cuts are drawn from its
   own id, and their places are found by a select in the list; the text is not split again.

A text of very many copies has several entries (each a part of its documents): see `distinct_texts`.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship, slices

#: Share of documents (of 100) whose order is changed, and of these the share that begins with the suffix.
PERCENT, SUFFIX_FIRST = 90, 20
MARKS = ("<P>", "<S>", "<M>")
#: An entry has at most about so many documents, or one 65,536th of all of them, whichever is more.
ENTRY_DOCUMENTS = 1_024
ENTRIES = 65_536


# ---- Elias-Fano lists ---------------------------------------------------------------------------------------------


def encode_list(values: np.ndarray, top: int) -> bytes:
    """Ascending values of at most `top` in Elias-Fano form: number of values and of low bits, high words, low bits."""
    n = len(values)
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    words = np.zeros((n + (top >> low_bits) + 1 + 63) // 64, np.uint64)
    if n:
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(words, ones // 64, np.uint64(1) << (ones % 64).astype(np.uint64))
    low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([n, low_bits, len(words)], "<u8").tobytes() + words.astype("<u8").tobytes() + np.packbits(low.ravel(), bitorder="little").tobytes()


class EliasFano:
    """Random access to an encoded list."""

    def __init__(self, raw: bytes):
        self.n, self.low_bits, words = (int(x) for x in np.frombuffer(raw, "<u8", 3))
        self.words = np.frombuffer(raw, "<u8", words, 24)
        self.low = np.frombuffer(raw, np.uint8, -1, 24 + 8 * words)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values number i (from 0)."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i, side="right") - 1
        left = i - self.before[word]
        place = np.zeros(len(i), np.int64)
        rest = self.words[word]
        for width in (32, 16, 8, 4, 2, 1):  # which half of the word has the wanted one
            half = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            above = left >= half
            left, place = np.where(above, left - half, left), np.where(above, place + width, place)
            rest = np.where(above, rest >> np.uint64(width), rest & np.uint64((1 << width) - 1))
        high = 64 * word + place - i
        low = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return (high << self.low_bits) | low


def token_ends(text: str) -> np.ndarray:
    """The end, in code points, of each token `[A-Za-z]+|[^A-Za-z]`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    last = np.ones(len(points), bool)
    last[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(last) + 1


# ---- the index ----------------------------------------------------------------------------------------------------


def _keyed(df: DataFrame, doc: str, text: str) -> DataFrame:
    base = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.select("doc", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))


def distinct_texts(df: DataFrame, *, doc: str = "doc_id", text: str = "text", most: int = ENTRY_DOCUMENTS) -> DataFrame:
    """d1, d2 (a digest), text and docs, the ids of the documents that have this very text.

    One entry for each different text, but for texts of more than `most` copies (or one ENTRIES-th of all rows, if that is
    more): their documents are dealt to several entries, so that no list of ids and no task grows with a group. Digests of
    such texts number ENTRIES at most, whatever the size of df; that list alone is broadcast.
    """
    spark = df.sparkSession
    keyed = _keyed(df, doc, text)
    counts = keyed.groupBy("d1", "d2").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    total = df.count()
    share = max(most, total // ENTRIES)
    rows = counts.where(F.col("copies") > share).collect()  # fewer than total / share, which is ENTRIES at most
    hot = spark.createDataFrame([(r["d1"], r["d2"], -(-r["copies"] // share)) for r in rows], "d1 long, d2 long, parts long")
    dealt = keyed.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)))
    # ids in structs, as lists drop nulls
    return dealt.groupBy("d1", "d2", "part", "text").agg(F.collect_list(F.struct("doc")).alias("docs")).select("d1", "d2", "text", F.col("docs.doc").alias("docs"))


def _with_lists(batches):
    """Batches of entries with n_tokens and ends, each text's list worked out once."""
    import pyarrow as pa

    for big in batches:
        for batch in slices(big):
            texts = batch.column("text").to_pylist()
            ends = [token_ends(t) for t in texts]
            lists = [encode_list(e, len(t)) for t, e in zip(texts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e) for e in ends], pa.int64()), pa.array(lists, pa.binary())], [*batch.schema.names, "n_tokens", "ends"])


def boundary_index(df: DataFrame, **more) -> DataFrame:
    """The entries of distinct_texts with n_tokens and ends, the Elias-Fano list of token ends."""
    entries = distinct_texts(df, **more)
    ship(df.sparkSession)
    return entries.mapInArrow(_with_lists, T.StructType([*entries.schema, T.StructField("n_tokens", T.LongType()), T.StructField("ends", T.BinaryType())]))


# ---- cuts ---------------------------------------------------------------------------------------------------------


def seeded(doc: int | None, seed: str = "1") -> tuple[int, int, int, int]:
    """Four 32-bit numbers from a document's id; those of a null id are from the seed alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
#: Bytes of output that go back to Spark at once, about.
OUTPUT_BYTES = 8 << 20


def fill_in_middle(df: DataFrame, *, doc: str = "doc_id", text: str = "text", seed: str = "1", percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST, most: int = ENTRY_DOCUMENTS) -> DataFrame:
    """One row for each row of df: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null
    if plain) and output, the text in that form.

    A null text is empty, and an empty text is plain; so is one that contains a mark. Rows with null ids are cut as the seed
    says; repeated rows come back as often as they are there. Other columns of df have no part in it; an empty df gives
    no rows.
    """
    import pyarrow as pa

    entries = distinct_texts(df, doc=doc, text=text, most=most).select("text", "docs")
    ship(df.sparkSession)

    def run(batches):
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], OUT.names)

        for batch in _with_lists(batches):  # the index's lists, in the same pass
            for t, docs, n, raw in zip(batch.column("text"), batch.column("docs"), batch.column("n_tokens").to_pylist(), batch.column("ends"), strict=True):
                t, docs = t.as_py(), docs.as_py()
                marked = not t or any(m in t for m in MARKS)
                draws = [seeded(d, seed) for d in docs]
                cuts = np.sort(np.array([(a % (n + 1), b % (n + 1)) for a, b, _, _ in draws], np.int64), axis=1)
                if marked:
                    places = np.zeros_like(cuts)
                else:
                    ends = EliasFano(raw.as_py())
                    places = np.where(cuts > 0, ends.select(np.maximum(cuts - 1, 0).ravel()).reshape(cuts.shape), 0)
                for d, (_, _, h3, h4), (a, b) in zip(docs, draws, places.tolist(), strict=True):
                    if marked or h3 % 100 >= percent:
                        rows.append((d, n, "plain", None, None, t))
                    elif h4 % 100 < suffix_first:
                        rows.append((d, n, "spm", a, b - a, f"{MARKS[1]}{t[b:]}{MARKS[0]}{t[:a]}{MARKS[2]}{t[a:b]}"))
                    else:
                        rows.append((d, n, "psm", a, b - a, f"{MARKS[0]}{t[:a]}{MARKS[1]}{t[b:]}{MARKS[2]}{t[a:b]}"))
                    size += len(t)
                    if size >= OUTPUT_BYTES:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return entries.mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    Marks are found from the left: a text without marks can't form one together with a mark beside it, as no mark begins as
    another one ends.
    """
    p, s, m = (F.instr(output, x) for x in MARKS)
    size = len(MARKS[0])
    part = lambda a, b: F.substring(output, a + size, b - a - size)
    middle = F.substring(output, m + size, F.char_length(output))
    psm, spm = F.concat(part(p, s), middle, part(s, m)), F.concat(part(p, m), middle, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
