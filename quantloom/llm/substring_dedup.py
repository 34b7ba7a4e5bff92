"""Operator 8, substring dedup: passages that stand in an earlier document, by a compressed FM-index for each shard.

A window is `window` consecutive words. It is taken out where its words also start a window in a document of a smaller
id. Windows are dealt to shards so that equal ones meet: of the hashed `ANCHOR`-word grams in a window the smallest is
its key, and a run of windows of one document with one key travels as one stretch of text.

1. Keys of every document's runs, with a 128-bit digest of each run's text; the words stay where they are.
2. Keys that only one document has lead nowhere; of runs with equal texts one is sent for all, with the smallest and the
   largest id that have it.
3. Each shard streams stretches of later documents against FM-indexes of earlier ones: in a key's group the documents
   are numbered by id, and for each bit of these numbers those with a 0 there are indexed and those with a 1, which agree
   in all higher bits, are streamed. So each document meets every earlier one of its group once, each stretch goes into
   as many indexes as the group's size has bits, and nothing but the length of a match decides: where the matching
   statistics reach `window`, an earlier document has the window. The words are numbered by their bytes, so matches are exact.
4. Runs look up what was reported for their texts, and documents cut out what an earlier one has.

A key that more than HOT_TEXTS different texts have (around a passage in a large share of all documents) would make one
group large. Its windows are dealt one by one, by a 128-bit digest of all their words, so that only those which recur
travel; these windows are found by their digests, not by the index, and two of different words would be taken for one
with a chance of 2 ** -128 for each pair. A document holds them as chains of windows, cut where a window's digest says
so, which many documents have in common: windows are looked up once for each different chain. Which keys these are is
told to the tasks by a bitmap of fixed size (MARK_BITS bits), whatever their number: a key that shares its bit is dealt
in the same way, with the same results, but more of them as the map fills. Bitmaps also say which documents a join is about, so that the others' texts stay
where they are; a document that shares its bit goes along and changes nothing.

Rows of one id are one document: their texts meet in one task, so that an id must not be that of a large share of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import SLICE, Scratch, Words, grams, ship, slices
from .fm_index import FMIndex

WINDOW = 50
ANCHOR = 8
#: Words in one shard's block, about: it is cut where a key ends.
SHARD_WORDS = 1 << 18
#: Windows in one stretch at the most: longer runs (of periodic texts) are several.
PIECE = 64
#: Different texts of one key from which on its windows are dealt one by one.
HOT_TEXTS = 300
#: Bits of the maps of keys and documents that are broadcast (4 MB each). Results don't hang on it, but costs do: with more
#: concerned documents than a fraction of this, raise it (a power of two; at 1 << 30 a map has 128 MB).
MARK_BITS = 1 << 25

RUNS = "key long, c1 long, c2 long, doc long, whole long, first int, n int"


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    n, size = len(x) - span + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[span - size : span - size + n])


def _arange_each(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def runs_of(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most PIECE windows with one key: first word (in the batch), windows, key."""
    k = min(ANCHOR, window)
    m = sliding_min(grams(w.hashes(), k), window - k + 1)
    counts = np.maximum(np.diff(w.bounds) - window + 1, 0)
    place = np.repeat(w.bounds[:-1], counts) + _arange_each(counts)  # where windows begin
    if not len(place):
        return place, place, place
    keys = m[place]
    row = np.repeat(np.arange(len(counts)), counts)
    edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))))
    n = np.diff(np.append(edge, len(keys)))
    pieces = -(-n // PIECE)
    behind = _arange_each(pieces) * PIECE
    edge, n = np.repeat(edge, pieces) + behind, np.minimum(np.repeat(n, pieces) - behind, PIECE)
    return place[edge], n, keys[edge]


def _digests(data, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of stretches of bytes, as pairs of numbers."""
    import xxhash

    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)


def whole_digest(raw: bytes | memoryview) -> int:
    """Tells apart the texts of rows with one id."""
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _wholes(w: Words) -> np.ndarray:
    view, o = memoryview(np.ascontiguousarray(w.data)), w.offsets.tolist()
    return np.array([whole_digest(view[a:z]) for a, z in zip(o, o[1:])], np.int64)


def _extract(docs: DataFrame, window: int) -> DataFrame:
    """The runs of docs (doc, text)."""
    import pyarrow as pa

    def run(batches):
        for big in batches:
            for batch in slices(big):
                w = Words(batch.column("text"))
                first, n, key = runs_of(w, window)
                content = _digests(w.data, w.starts[first], w.ends[first + n + window - 2])
                row = np.searchsorted(w.bounds, first, side="right") - 1
                doc = batch.column("doc").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy()), doc, pa.array(_wholes(w)[row]), pa.array((first - w.bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "c1", "c2", "doc", "whole", "first", "n"])

    return docs.mapInArrow(run, RUNS)


CHAINS = "d1 long, d2 long, doc long, whole long, first int, windows array<struct<c1: long, c2: long>>"


def _chains(docs: DataFrame, window: int, bits: np.ndarray, concerned: np.ndarray | None) -> DataFrame:
    """The windows of hot keys, of the documents that have some, as chains of at most PIECE windows that follow each other;
    a window's digest is of its words with a space between, a chain's of its windows' digests."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast((bits, concerned))

    def run(batches):
        own, whose = sent.value
        for big in batches:
            for batch in slices(_chosen(big, "doc", whose)):
                w = Words(batch.column("text"))
                first, n, key = runs_of(w, window)
                hot = marked(own, key.view(np.int64))
                if not hot.any():
                    continue
                first = np.repeat(first[hot], n[hot]) + _arange_each(n[hot])
                sizes = w.ends - w.starts
                to = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes + 1, out=to[1:])
                line = np.full(int(to[-1]), 32, np.uint8)
                line[np.repeat(to[:-1], sizes) + _arange_each(sizes)] = w.data[w.letters]
                content = _digests(line, to[first], to[first + window] - 1)
                row = np.searchsorted(w.bounds, first, side="right") - 1
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(first) != 1) | (np.diff(row) != 0) | (content[1:, 0] & 15 == 0))))
                n = np.diff(np.append(edge, len(first)))
                pieces = -(-n // PIECE)
                edge = np.repeat(edge, pieces) + _arange_each(pieces) * PIECE
                ends = np.append(edge[1:], len(first))
                chain = _digests(content.view(np.uint8).ravel(), edge * 16, ends * 16)
                windows = pa.StructArray.from_arrays([pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy())], ["c1", "c2"])
                at = row[edge]
                yield pa.RecordBatch.from_arrays([
                    pa.array(chain[:, 0].copy()), pa.array(chain[:, 1].copy()), batch.column("doc").take(pa.array(at)), pa.array(_wholes(w)[at]), pa.array((first[edge] - w.bounds[at]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(edge, len(first)).astype(np.int32)), windows),
                ], ["d1", "d2", "doc", "whole", "first", "windows"])

    return docs.mapInArrow(run, CHAINS)


def _place(column) -> Column:
    return F.col(column).bitwiseAND(MARK_BITS - 1) + 1


def marks(df: DataFrame, column: str) -> np.ndarray | None:
    """A bitmap of the values of a column of longs, by their last bits; None if there are none."""
    places = df.select(_place(column).alias("place"))
    parts = places.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect()
    bits = np.zeros(MARK_BITS // 8, np.uint8)
    for p in parts:  # of 4,096 bytes each, at most so many as make up the bitmap
        raw = np.frombuffer(p["bits"], np.uint8)
        at = (p["bucket"] - 1) * len(raw)
        bits[at : at + len(raw)] = raw[: len(bits) - at]
    return bits if parts else None


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1


def packed(df: DataFrame, text: str, doc: str, bits: np.ndarray | None, name: str = "__packed") -> DataFrame:
    """The rows of df whose id is marked, with their text as a zstandard frame in a column `name`, for the way through a shuffle."""
    import pyarrow as pa

    others = [f for f in df.schema.fields if f.name != text]
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import zstandard

        c, own = zstandard.ZstdCompressor(level=1), sent.value
        for big in batches:
            for batch in slices(_chosen(big, doc, own), text):
                frames = pa.array([None if t is None else c.compress(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], frames], [*[f.name for f in others], name])

    return df.mapInArrow(run, T.StructType([*others, T.StructField(name, T.BinaryType())]))


def _chosen(batch, doc: str, bits: np.ndarray | None, other: bool = False):
    """The rows whose id is marked, or all others."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = batch.column(doc)
    hit = np.zeros(batch.num_rows, bool) if bits is None else marked(bits, np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))) & np.asarray(ids.is_valid())
    return batch.filter(pa.array(hit != other))


def unpacked(batches, name: str = "__packed", most: int = SLICE) -> Iterator[tuple]:
    """Runs of rows and their texts as bytes (None for null), with at most so many bytes of text together, or one row."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    for big in batches:
        texts, size, begin = [], 0, 0
        for i, frame in enumerate(big.column(name)):
            frame = frame.as_py()
            more = 0 if frame is None else zstandard.get_frame_parameters(frame).content_size
            if texts and size + more > most:
                yield big.slice(begin, len(texts)), texts
                texts, size, begin = [], 0, i
            texts.append(None if frame is None else d.decompress(frame))
            size += more
        if texts:
            yield big.slice(begin, len(texts)), texts


STRETCHES = "key long, c1 long, c2 long, low long, high long, words binary"


def _stretches(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The text of each wanted run: rows (key, c1, c2, low, high, words)."""
    import pyarrow as pa

    kinds = (pa.int64(),) * 5 + (pa.binary(),)

    def run(batches):
        for batch, texts in unpacked(batches):
            w = Words(pa.array(texts, pa.large_binary()))
            out: list[tuple] = []
            for i, (mine, low, wants) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("doc").to_pylist(), batch.column("wants").to_pylist(), strict=True)):
                if whole_digest(texts[i]) != mine:
                    continue  # another row of the same id
                s, e, base, first = w.starts, w.ends, int(w.offsets[i]), int(w.bounds[i])
                for x in wants:
                    a, z = first + x["first"], first + x["first"] + x["n"] + window - 2
                    out.append((x["key"], x["c1"], x["c2"], low, x["high"], texts[i][int(s[a]) - base : int(e[z]) - base]))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "c1", "c2", "low", "high", "words"])
            yield from slices(whole, "words")

    return docs.join(wanted, "doc").select("__packed", "doc", "whole", "wants").mapInArrow(run, STRETCHES)


def search(keys: np.ndarray, low: np.ndarray, high: np.ndarray, symbols: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the stretches (of keys in order, found in documents low and, where high > low, in a later one too)
    whether a window that begins there stands in an earlier document of its key's group: than low, and than high."""
    n = len(keys)
    group = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    later = np.flatnonzero(high > low)
    # each document's number in its group, by id
    who, of = np.concatenate((group, group[later])), np.concatenate((low, high[later]))
    order = np.lexsort((of, who))
    same = np.concatenate(([False], (who[order][1:] == who[order][:-1])))
    step = np.concatenate(([0], (of[order][1:] != of[order][:-1]).astype(np.int64)))
    number = np.cumsum(np.where(same, step, 0))
    number -= np.maximum.accumulate(np.where(same, 0, number))
    place = np.empty(len(who), np.int64)
    place[order] = number
    most = np.zeros(int(group[-1]) + 1, np.int64)
    np.maximum.at(most, who, place)
    own, second, top = place[:n], place[n:], most[group]
    indexed, streamed, again = [], [], []  # stretches and tags: words of documents that differ in a higher bit are different words
    for bit in range(int(most.max()).bit_length()):
        tag = lambda x: (x >> bit + 1) * 64 + bit  # noqa: B023, E731
        which = np.flatnonzero((own >> bit & 1 == 0) & (((own >> bit) + 1 << bit) <= top))
        indexed.append((which, tag(own[which])))
        which = np.flatnonzero(own >> bit & 1)
        streamed.append((which, tag(own[which])))
        # a copy once: where the document that is indexed for this text has a 0 and this one a 1
        which = np.flatnonzero((own[later] ^ second) >> bit == 1)
        again.append((later[which], tag(second[which])))
    before, copied = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
    if not indexed:
        return before, copied
    lengths, width = np.diff(bounds), int(symbols.max()) + 1

    def gather(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, tags = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = lengths[which]
        words = np.repeat(bounds[:-1][which], sizes) + _arange_each(sizes)
        return symbols[words] + np.repeat(tags, sizes) * width, np.concatenate(([0], np.cumsum(sizes))), words

    index = FMIndex(*gather(indexed)[:2], window)
    asked, ends, words = gather(streamed + again)
    found = index.statistics(asked, ends, window) >= window
    cut = int(sum(lengths[which].sum() for which, _ in streamed))
    np.logical_or.at(before, words[:cut], found[:cut])
    np.logical_or.at(copied, words[cut:], found[cut:])
    return before, copied


def _ranges(found: np.ndarray, bounds: np.ndarray):
    """Of each stretch the runs of found windows, as a list of first word, windows, first word, windows .."""
    import pyarrow as pa

    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    head = found.copy()
    head[1:] &= ~found[:-1] | (owner[1:] != owner[:-1])
    tail = found.copy()
    tail[:-1] &= ~found[1:] | (owner[1:] != owner[:-1])
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    flat = np.stack((first - bounds[owner[first]], last - first + 1), axis=1).ravel().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((2 * np.searchsorted(owner[first], np.arange(len(bounds)))).astype(np.int32)), pa.array(flat))


def _report(stretches: DataFrame, window: int, parts: int) -> DataFrame:
    """For each run (key, c1, c2) found in a document low: the ranges of windows that a document before low has, and those
    that one before any later document of the same text has."""
    import pyarrow as pa

    def shard(held):
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        w = Words(block.column("words"))
        keys, low = np.asarray(block.column("key")), np.asarray(block.column("low"))
        before, copied = search(keys, low, np.asarray(block.column("high")), w.coded()[0], w.bounds, window)
        return pa.RecordBatch.from_arrays([*[block.column(c) for c in ("key", "c1", "c2", "low")], _ranges(before, w.bounds), _ranges(copied, w.bounds)], ["key", "c1", "c2", "low", "before", "copied"])

    def run(batches):
        held, size = [], 0
        for big in batches:
            for batch in slices(big, "words"):
                keys = np.asarray(batch.column("key"))
                if size >= SHARD_WORDS:  # cut where a key ends
                    last = held[-1].column("key")[-1].as_py()
                    same = int(np.searchsorted(keys != last, True))
                    if same:
                        held.append(batch.slice(0, same))
                        batch = batch.slice(same)
                    if batch.num_rows:
                        yield shard(held)
                        held, size = [], 0
                if batch.num_rows:
                    held.append(batch)
                    size += batch.column("words").nbytes // 6
        if held:
            yield shard(held)

    return stretches.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, c1 long, c2 long, low long, before array<int>, copied array<int>")


def repeated_windows(df: DataFrame, scratch: Scratch, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, whole (digest of its text) and found (first word, ranges): what each document's runs were told."""
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    runs = scratch.written(_extract(docs, window), "runs")
    source = F.min(F.struct("doc", "whole", "first", "n")).alias("r")
    texts = scratch.written(runs.groupBy("key", "c1", "c2").agg(source, F.max("doc").alias("high")), "texts")
    hot = scratch.written(texts.groupBy("key").count().where(F.col("count") > HOT_TEXTS).select("key"), "hot")
    bits = marks(hot, "key")
    places = hot.select(_place("key").alias("place")).distinct()
    light = texts if bits is None else texts.withColumn("place", _place("key")).join(places, "place", "left_anti").drop("place")
    different = light.selectExpr("*", "min(r.doc) over (partition by key) x", "max(high) over (partition by key) y").where("x < y").drop("x", "y")
    if bits is not None:
        concerned = marks(runs.withColumn("place", _place("key")).join(places, "place", "left_semi"), "doc")
        chains = scratch.written(_chains(docs, window, bits, concerned), "chains")
        once = chains.groupBy("d1", "d2").agg(F.min(F.struct("doc", "whole", "first", "windows")).alias("r"), F.max("doc").alias("high"))
        once = once.select("d1", "d2", "high", "r.*").select("*", F.posexplode("windows").alias("at", "w"))
        once = scratch.written(once.select("d1", "d2", "doc", "whole", "first", "high", "at", "w.c1", "w.c2"), "once")
        singles = once.groupBy(F.col("c1").alias("key"), "c1", "c2").agg(F.min(F.struct("doc", "whole", (F.col("first") + F.col("at")).alias("first"), F.lit(1).alias("n"))).alias("r"), F.max("high").alias("high"))
        different = different.unionByName(singles.where("r.doc < high"))
    wanted = different.groupBy(F.col("r.doc").alias("doc"), F.col("r.whole").alias("whole")).agg(F.collect_list(F.struct("key", "c1", "c2", F.col("r.first").alias("first"), F.col("r.n").alias("n"), "high")).alias("wants"))
    wanted = scratch.written(wanted, "wanted")
    scratch.drop("texts", "hot")
    told = _report(_stretches(packed(docs, "text", "doc", marks(wanted, "doc")), wanted, window), window, parts)
    told = scratch.written(told, "told").where(F.size("before") + F.size("copied") > 0)
    ranges = F.when(F.col("doc") == F.col("low"), F.col("before")).otherwise(F.col("copied"))
    hits = runs.join(told, ["key", "c1", "c2"]).select("doc", "whole", "first", ranges.alias("ranges"))
    if bits is not None:
        answers = once.select("d1", "d2", "at", "c1", "c2").join(told.where("key = c1").select("c1", "c2", "low"), ["c1", "c2"])
        answers = answers.groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("at", "low"))).alias("answers"))
        later = F.filter("answers", lambda x: x["low"] < F.col("doc"))
        hits = hits.union(chains.drop("windows").join(answers, ["d1", "d2"]).select("doc", "whole", "first", F.flatten(F.transform(later, lambda x: F.array(x["at"], F.lit(1)))).alias("ranges")))
    return hits.where(F.size("ranges") > 0).groupBy("doc", "whole").agg(F.collect_list(F.struct("first", "ranges")).alias("found"))


def remove_repeats(df: DataFrame, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW, counts: Sequence[str] | None = ("n_words", "n_removed")) -> DataFrame:
    """df with each text cut: words of a repeated window go, with the white space behind them; other texts stay as they are.

    counts names two columns for a text's words and the words that went (they replace columns of these names; None: no
    such columns). A null text is left null, with no words; rows of a null id neither lose words nor make others lose
    any. Of rows with equal ids each is cut by its own text, and they don't count as earlier than each other. All other
    columns stay; an empty df gives no rows. Texts of any length are taken whole: vector steps hold SLICE bytes of text,
    or one text where that is longer.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    base = df.drop(*(counts or ()))
    found = repeated_windows(df, scratch, doc=doc, text=text, window=window).select(F.col("doc").alias("__doc"), F.col("whole").alias("__whole"), F.col("found").alias("__found"))
    # one row for each id: rows of one id may differ in text
    found = scratch.written(found.groupBy("__doc").agg(F.collect_list(F.struct("__whole", "__found")).alias("__all")), "found")
    scratch.drop("runs", "chains", "once", "wanted", "told")
    bits = marks(found, "__doc")
    names = [f.name for f in base.schema.fields]
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.LongType()) for c in counts or ()]])
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def result(batch, column, total: np.ndarray, gone: np.ndarray):
        columns = {text: column}
        if counts:
            columns |= {counts[0]: pa.array(total.astype(np.int64)), counts[1]: pa.array(gone)}
        return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in schema.names], schema.names)

    def whole(batches):
        for big in batches:
            for batch in slices(_chosen(big, doc, sent.value, other=True), text):
                total = np.diff(Words(batch.column(text)).bounds) if counts else np.zeros(batch.num_rows)
                yield result(batch, batch.column(text), total, np.zeros(batch.num_rows, np.int64))

    def cut(batches):
        for batch, texts in unpacked(batches):
            w = Words(pa.array([t or b"" for t in texts], pa.large_binary()))
            total, gone = np.diff(w.bounds), np.zeros(batch.num_rows, np.int64)
            for i, hits in enumerate(batch.column("__all").to_pylist()):
                if not hits or texts[i] is None:
                    continue
                mask = np.zeros(int(total[i]) + 1, np.int64)
                mine = whole_digest(texts[i])
                for hit in hits:
                    if hit["__whole"] == mine:
                        first = np.concatenate([np.array(f["ranges"][::2], np.int64) + f["first"] for f in hit["__found"]])
                        times = np.concatenate([np.array(f["ranges"][1::2], np.int64) for f in hit["__found"]])
                        np.add.at(mask, first, 1)
                        np.add.at(mask, first + times - 1 + window, -1)
                covered = np.cumsum(mask[:-1]) > 0
                gone[i] = covered.sum()
                if gone[i]:
                    texts[i] = _cut(texts[i], w.starts[w.bounds[i] : w.bounds[i + 1]] - w.offsets[i], covered)
            yield result(batch, pa.array([None if t is None else t.decode() for t in texts], pa.string()), total, gone)

    joined = packed(base, text, doc, bits).join(found, F.col(doc).cast("long") == F.col("__doc"), "left")
    return base.mapInArrow(whole, schema).union(joined.select(*[c for c in names if c != text], "__packed", "__doc", "__all").mapInArrow(cut, schema))


def _cut(raw: bytes, starts: np.ndarray, covered: np.ndarray) -> bytes:
    """The text without its covered words: each goes with what stands up to the next word or the end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    parts, at = [], 0
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(raw[at : int(starts[a])])
        at = int(starts[z]) if z < len(starts) else len(raw)
    return b"".join((*parts, raw[at:]))
