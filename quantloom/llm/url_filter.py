"""Operator 2, URL filters: rules in a sorted digest array.

A rule is a host and a path; its key is the string host + path. Keys of 64 bits (xxhash) are sorted, next to the full
strings they stand for. A probe is a vectorised binary search in the memory-mapped array, and counts only if the stored
string equals the probed one, so colliding digests do no harm.

A list of at most BROADCAST_BYTES is sent to the executors whole (its size is checked); a larger one is dealt over
shards by digest, and each shard's probes meet its part of the array.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ascii_lower, ship

#: The largest array that is broadcast.
BROADCAST_BYTES = 64 << 20
#: (host, path, verdict), as the contract of the query has them.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules of a shard, about.
SHARD_RULES = 500_000
#: The verdict where no rule fits: the list names what is judged, all else is let through.
DEFAULT = "allow"


_LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class DigestArray:
    """Strings under sorted 64-bit digests, in one mapped block of bytes: count, digests, offsets, values, strings."""

    def __init__(self, block):
        self.block = block
        n = int(np.frombuffer(block, np.int64, 1)[0])
        self.keys = np.frombuffer(block, np.uint64, n, 8)
        self.offsets = np.frombuffer(block, np.int64, n + 1, 8 + 8 * n)
        self.values = np.frombuffer(block, np.int32, n, 16 + 16 * n)
        self.text_at = 16 + 20 * n

    @staticmethod
    def pack(items: Iterable[tuple[str, int]]) -> bytes:
        """Of equal strings the first stays."""
        own: dict[bytes, int] = {}
        for text, value in items:
            own.setdefault(text.encode("utf-8", "surrogatepass"), value)
        keyed = sorted((xxhash.xxh64_intdigest(t), t, v) for t, v in own.items())
        n = len(keyed)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for _, t, _ in keyed], out=offsets[1:])
        return b"".join((np.int64(n).tobytes(), np.array([k for k, _, _ in keyed], np.uint64).tobytes(), offsets.tobytes(), np.array([v for _, _, v in keyed], np.int32).tobytes(), *(t for _, t, _ in keyed)))

    @classmethod
    def mapped(cls, block: bytes) -> DigestArray:
        """Over a file of this task's own that is gone from the folder at once; the kernel keeps its pages while mapped."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def probe(self, texts: Sequence[str]) -> np.ndarray:
        """The value of each string, -1 if it isn't there."""
        out = np.full(len(texts), -1, np.int32)
        if not len(self.keys) or not len(texts):
            return out
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        wanted = np.fromiter((xxhash.xxh64_intdigest(t) for t in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, wanted)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # strings whose digests collide stand together
                if self.block[self.text_at + int(self.offsets[k]) : self.text_at + int(self.offsets[k + 1])] == raw[i]:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def host_of(url):
    """What follows the first :// up to / ? # or the end, A-Z lowered; empty for null or no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(host: str, path: str, lengths: Sequence[int]) -> Iterator[str]:
    """Keys of the rules that may fit, longest first by host, then by path."""
    while True:
        for n in lengths:
            if n <= len(path):
                yield f"{host}\0{path[:n]}"
        dot = host.find(".")
        if dot < 0:
            return
        host = host[dot + 1 :]


def _judge_pairs(array: DigestArray, rules, lengths, pairs: Sequence[tuple[str, str]]) -> list[int]:
    """For each (host, path) the number of the longest rule that fits, or -1."""
    keys, owner = [], []
    for i, (host, path) in enumerate(pairs):
        for key in _candidates(host, path, lengths):
            keys.append(key)
            owner.append(i)
    best = [-1] * len(pairs)
    for i, found in zip(owner, array.probe(keys).tolist(), strict=True):
        if found >= 0 and (best[i] < 0 or len(rules[found][0]) + len(rules[found][1]) > len(rules[best[i]][0]) + len(rules[best[i]][1])):
            best[i] = found
    return best


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """keep columns, host, path, rule and verdict of each row.

    rules: (host, path, verdict), of hosts A-Z lowered; a rule fits its host and all subdomains where the path starts with
    the rule's, and the longest wins: of equally long ones that of the longer host, of equal ones the first. A null url, or one without ://, has an empty host and path, which only rules with both empty fit.
    Repeated rows are judged alike; columns that aren't in keep are left out, so that clashing names do no harm.
    """
    rules = [(h.translate(_LOWERED), p, v) for h, p, v in rules]
    block = DigestArray.pack((f"{h}\0{p}", i) for i, (h, p, _) in enumerate(rules))
    if len(block) > BROADCAST_BYTES:
        raise ValueError("the list is larger than what is broadcast: use judge_urls_sharded")
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((block, rules))
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    base = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def judge(batches):
        import pyarrow as pa

        packed, known = sent.value
        array = DigestArray.mapped(packed)
        for batch in batches:
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            best = _judge_pairs(array, known, lengths, pairs)
            rule = pa.array([known[b][0] + known[b][1] if b >= 0 else None for b in best], pa.string())
            verdict = pa.array([known[b][2] if b >= 0 else default for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    from pyspark.sql import types as T

    return base.mapInArrow(judge, T.StructType([*base.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def judge_urls_sharded(df: DataFrame, rules: DataFrame, *, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = DEFAULT, shards: int | None = None) -> DataFrame:
    """judge_urls for a list of any size: rules has columns host, path, verdict.

    Distinct probe keys and rule keys meet in the shard of their digest, where the shard's sorted array answers; rows
    then look up their keys' answers. Distinct keys come from partial aggregation, so a key of many rows is one probe.
    Shards are so many that each has about SHARD_RULES rules. Of rules with equal host and path, which have no order in
    a table, that of the smallest verdict counts.
    """
    spark: SparkSession = df.sparkSession
    ship(spark)
    own = rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).where("h is not null and p is not null")
    own = own.groupBy("h", "p").agg(F.min("v").alias("v"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // SHARD_RULES))
    lengths = [r[0] for r in own.select(F.length("p")).distinct().limit(4097).collect()]
    if len(lengths) > 4096:
        raise ValueError("rules have more than 4096 lengths of path")
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    base = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda m: m <= F.length("path")), lambda m: F.concat(h, F.lit("\0"), F.substring(F.col("path"), F.lit(1), m)))))
    pairs = base.select("host", "path").distinct().withColumn("key", F.explode(keys))
    shard = F.pmod(F.xxhash64("key"), F.lit(n)).alias("shard")
    probes = pairs.select("key").distinct().select(shard, "key")
    listed = own.select(F.concat("h", F.lit("\0"), "p").alias("key"), F.concat("h", "p").alias("rule"), "v", F.struct(F.length(F.concat("h", "p")).alias("all"), F.length("h").alias("host")).alias("size"))
    listed = listed.select(shard, "key", "rule", "v", "size")

    def answer(left, right):
        import pyarrow as pa

        known = right.to_pylist()
        array = DigestArray.mapped(DigestArray.pack((r["key"], i) for i, r in enumerate(known)))
        wanted = left.column("key").to_pylist()
        got = [(k, known[v]) for k, v in zip(wanted, array.probe(wanted).tolist(), strict=True) if v >= 0]
        return pa.table({"key": pa.array([k for k, _ in got], pa.string()), "rule": pa.array([r["rule"] for _, r in got], pa.string()), "verdict": pa.array([r["v"] for _, r in got], pa.string()), "size": pa.array([r["size"] for _, r in got], pa.struct([("all", pa.int32()), ("host", pa.int32())]))})

    found = probes.groupBy("shard").cogroup(listed.groupBy("shard")).applyInArrow(answer, "key string, rule string, verdict string, size struct<all: int, host: int>")
    best = pairs.join(found, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.col("size")).alias("best"))
    out = base.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
