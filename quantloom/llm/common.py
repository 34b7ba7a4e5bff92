"""What the operators of this subpackage share: table access, shared storage, shipping code, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shipping import ship  # noqa: F401 (operators take it from here)

#: ASCII white space that separates words: space, tab, \n, \v, \f, \r.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs in one process
    (tests), a temporary one is made; on a cluster without it, executors couldn't read what others wrote: an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one run in the shared folder. A written table cuts the lineage and survives lost executors.

    drop() deletes those that nothing reads any more; the rest, which results still read, goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, what: str) -> DataFrame:
        """df as a Parquet table, read again."""
        name = f"{shared_dir(self.spark)}/quantloom/{self.spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
        path, fs = _path(self.spark, name)
        fs.deleteOnExit(path)
        df.write.parquet(name)
        self.paths[what] = name
        return self.spark.read.schema(df.schema).parquet(name)

    def drop(self, *what: str) -> None:
        for name in what:
            if name in self.paths:
                path, fs = _path(self.spark, self.paths.pop(name))
                fs.delete(path, True)
                fs.cancelDeleteOnExit(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; it is deleted when the application ends."""
    return Scratch(df.sparkSession).written(df, what)


def ascii_lower(column):
    """A-Z lowered, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- words of a batch of texts, by vector operations over the batch's bytes -------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that vector steps take at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string or binary column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch, *columns: str, most: int = SLICE):
    """The batch in runs of rows with at most so many bytes of text (or binary, or list items times eight) in the columns
    together, or one row: bounds what the vector steps hold."""
    total = sum(_bounds(batch.column(c)) for c in columns or ("text",))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


def _bounds(column) -> np.ndarray:
    import pyarrow as pa

    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.asarray(column.offsets, np.int64) * 8
    return text_buffer(column)[1]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch: starts and ends in the batch's bytes, and bounds[i]:bounds[i+1] for each row.

    apart: other bytes than white space that separate words, as a mask of 256."""

    def __init__(self, column, lower: bool = False, apart: np.ndarray = _IS_SPACE):
        self.data, self.offsets = text_buffer(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~apart[self.data]
        first = word[1:-1] & ~word[:-2]
        last = word[1:-1] & ~word[2:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]  # a row's end also ends a word
        first[inner] = word[inner + 1]
        last[inner - 1] = word[inner]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.letters = word[1:-1]

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and the different words by number: equal numbers, equal bytes."""
        import pyarrow as pa

        if not len(self.starts):
            return np.empty(0, np.int64), []
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        body = pa.py_buffer(self.data[self.letters])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), body]).dictionary_encode()
        return np.asarray(words.indices).astype(np.int64), words.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """64 bits of the xxh3 of each word's bytes."""
        return self.digests()[0]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit xxh3 of each word's bytes, in two halves."""
        import xxhash

        codes, words = self.coded()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        return both[codes, 0], both[codes, 1]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A value for each k consecutive words (k - 1 fewer than words); rows are not looked at.

    Each step goes through the finalizer, so that no arithmetic of the words' values carries over to that of their runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        value = mix(words[:n] + np.uint64(k))
        for j in range(1, k):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return value
