"""Operator 4, token ids in a binary format: one zstandard frame for each document under a shared dictionary.

A block holds consecutive documents: a header (magic, width of an id, hash of the dictionary, number of documents, ids
before the block in its part), the index (document id, number of ids, end of each frame) and the frames. Any document of
a block is read by its index entry alone: seek, decompress one short frame. The dictionary is trained on serialized id
lists of a bounded sample of documents and stored once, under its hash, beside the blocks.

Blocks are rows of a Parquet table with a binary column, so that Spark's committer makes them whole or not at all on any
file system that Spark writes to, and a lost executor's blocks are written again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import shared_dir, ship, slices
from .tokens import library_encoder

MAGIC = b"QLTOKZ01"
#: The end of each document.
END_ID = 2
#: Serialized ids in a block, about.
BLOCK_BYTES = 1 << 20
#: Documents on which the dictionary is trained, and the bytes of ids that each gives for that (the only sample here; it
#: has no part in what is read back).
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 1_000, 16 << 10
DICTIONARY_BYTES = 32 << 10
LEVEL = 1


def train_dictionary(samples: Sequence[bytes]) -> bytes:
    """Too little to train on gives the empty dictionary."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 10 else b""
    except zstandard.ZstdError:
        return b""


def _codec(kind, dictionary: bytes, **more):
    import zstandard

    if not dictionary:
        return kind(**more)
    known = zstandard.ZstdCompressionDict(dictionary)
    if "level" in more:
        known.precompute_compress(level=more["level"])  # once, not for each document
    return kind(dict_data=known, **more)


def pack_block(docs: Sequence[tuple[int | None, np.ndarray]], dictionary: bytes, before: int, compressor=None) -> bytes:
    """A block of (document id, ids); a null id is kept as such."""
    import zstandard

    compressor = compressor or _codec(zstandard.ZstdCompressor, dictionary, level=LEVEL)
    kind = np.dtype("<u2") if all(d.dtype.itemsize == 2 for _, d in docs) else np.dtype("<u4")
    frames = [compressor.compress(np.ascontiguousarray(ids, kind).tobytes()) for _, ids in docs]
    n = len(docs)
    head = np.array([kind.itemsize, xxhash.xxh64_intdigest(dictionary), n, before], "<u8").tobytes()
    known = np.array([x is not None for x, _ in docs], np.uint8).tobytes()
    names = np.array([x or 0 for x, _ in docs], "<i8").tobytes()
    sizes = np.array([len(ids) for _, ids in docs], "<i8").tobytes()
    ends = np.cumsum([len(f) for f in frames]).astype("<i8").tobytes()
    return b"".join((MAGIC, head, names, sizes, ends, known, *frames))


class Block:
    """Random access to a block's documents."""

    def __init__(self, raw: bytes, dictionary: bytes):
        import zstandard

        if raw[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        width, hashed, n, before = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
        if hashed != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the block was written with another dictionary")
        self.kind, self.n, self.before, self.raw = np.dtype(f"<u{width}"), n, before, raw
        self.names = np.frombuffer(raw, "<i8", n, 40)
        self.sizes = np.frombuffer(raw, "<i8", n, 40 + 8 * n)
        self.ends = np.frombuffer(raw, "<i8", n, 40 + 16 * n)
        self.known = np.frombuffer(raw, np.uint8, n, 40 + 24 * n)
        self.at = 40 + 25 * n
        self.codec = _codec(zstandard.ZstdDecompressor, dictionary)

    def ids(self, i: int) -> np.ndarray:
        a = self.at + (int(self.ends[i - 1]) if i else 0)
        return np.frombuffer(self.codec.decompress(self.raw[a : self.at + int(self.ends[i])]), self.kind)

    def name(self, i: int) -> int | None:
        return int(self.names[i]) if self.known[i] else None


BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])


def write_tokens(df: DataFrame, vocabulary: str, path: str | None = None, *, doc: str = "doc_id", text: str = "text", end_id: int = END_ID, parts: int | None = None) -> str:
    """Write the ids of each whole text, in ascending document order, to path; its name comes back.

    A null text is empty: its list is the end id alone. Rows of equal or null document ids stay rows of their own (null
    first, equal ones by text). An empty df writes no block. One shuffle deals the rows to ranges of document ids.
    """
    import pyarrow as pa
    import zstandard

    spark = df.sparkSession
    ship(spark)
    path = path or f"{shared_dir(spark)}/quantloom/tokens-{uuid.uuid4().hex}"
    base = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    share = 4 * SAMPLE_DOCUMENTS / max(1, base.count())  # so that a task sends its part of the sample, not as many as asked for
    sample = base.where(order <= int(share * (1 << 30))).orderBy(order, "doc").limit(SAMPLE_DOCUMENTS)

    def serialized(batches):
        own = library_encoder(vocabulary)
        for big in batches:
            for batch in slices(big):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()[:SAMPLE_BYTES] for x in own.encode(batch.column("text").to_pylist())], pa.binary())], ["ids"])

    dictionary = train_dictionary([bytes(r["ids"]) for r in sample.select("text").mapInArrow(serialized, "ids binary").collect()])
    spark.createDataFrame([(xxhash.xxh64_hexdigest(dictionary), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")

    def run(batches):
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), library_encoder(vocabulary)
        compressor = _codec(zstandard.ZstdCompressor, dictionary, level=LEVEL)
        held, size, before, count = [], 0, 0, 0

        def block():
            total = sum(len(ids) for _, ids in held)
            data = pack_block(held, dictionary, before, compressor)
            return total, pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], BLOCKS.names)

        for big in batches:
            for batch in slices(big):
                names = batch.column("doc").to_pylist()
                for name, ids in zip(names, own.ended(batch.column("text"), end_id), strict=True):
                    held.append((name, ids))
                    size += ids.nbytes
                    if size >= BLOCK_BYTES:
                        total, out = block()
                        yield out
                        held, size, before, count = [], 0, before + total, count + 1
        if held:
            yield block()[1]

    ranged.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, *, lists: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned
    32-bit integers) and, if lists, ids (array of int), read back from the blocks."""
    import pyarrow as pa

    ship(spark)
    dictionary = bytes(spark.read.schema("hash string, dictionary binary").parquet(f"{path}/dictionary").first()["dictionary"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each part, not for each document
    starts, total = {}, 0
    for part, n in sums:
        starts[part] = total
        total += n
    fields = [T.StructField(x, T.LongType()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")]
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if lists else fields)

    def run(batches):
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                b = Block(raw.as_py(), dictionary)
                each = [b.ids(i).astype("<u4") for i in range(b.n)]
                ends = np.cumsum(b.sizes)
                columns = [pa.array(b.names, pa.int64(), mask=b.known == 0), pa.array(starts[part] + b.before + ends - b.sizes), pa.array(b.sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if lists:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.concatenate(each).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return blocks.select("part", "data").mapInArrow(run, out)
