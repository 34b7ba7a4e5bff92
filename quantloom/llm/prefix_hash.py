"""Operator 12, document fingerprints: prefix polynomial hashes.

The code points of many texts stand one after the other in one array. Its prefix sums of `(code point + 1) * base ** place`
under two prime moduli answer for any two spans whether they are equal, by a subtraction, a shift by a power and a
comparison; the longest common extension of two places, forwards or backwards, is a binary search over such questions,
made for all rows of a slice at once. A fingerprint is a text's length and the hash of its whole span, moved to place 0.

Spans of different content are told to be equal with a chance of about 2 ** -60 for each question.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship, slices

#: The two largest primes below 2 ** 31, and a base for each, above all code points.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_919, 1_234_567_891)


def _powers(base: int, p: int, n: int, known: np.ndarray | None = None) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) or more, by doubling."""
    out = np.ones(1, np.uint64) if known is None else known
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)))
    return out


_power: list[np.ndarray | None] = [None, None]


class PrefixHashes:
    """Prefix hashes of some texts in one array. Text i covers places bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        self.bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=self.bounds[1:])
        points = np.concatenate(raw).astype(np.uint64) + np.uint64(1) if raw else np.empty(0, np.uint64)
        self.sums, self.powers = [], []
        for m, (base, p) in enumerate(zip(BASES, PRIMES)):
            _power[m] = _powers(base, p, len(points) + 1, _power[m])
            sums = np.zeros(len(points) + 1, np.uint64)
            # each term is below 2 ** 31, so that 2 ** 33 of them can be added up before the remainder is taken
            np.cumsum(points * _power[m][: len(points)] % np.uint64(p), out=sums[1:])
            sums %= np.uint64(p)
            self.sums.append(sums)
            self.powers.append(_power[m])

    def _span(self, m: int, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the spans of n places from a; its power depends on a."""
        p = np.uint64(PRIMES[m])
        return (self.sums[m][a + n] + p - self.sums[m][a]) % p

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n places from a and those from b have equal code points."""
        out = np.ones(len(a), bool)
        for m in (0, 1):
            p = np.uint64(PRIMES[m])
            shift = self.powers[m][np.abs(b - a)]
            x, y = self._span(m, a, n), self._span(m, b, n)
            out &= np.where(b >= a, x * shift % p == y, y * shift % p == x)
        return out

    def _longest(self, test, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = test(mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low

    def forwards(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of equal places from a and b on, at most `most`."""
        return self._longest(lambda n: self.equal(a, b, n), most)

    def backwards(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of equal places before a and b, at most `most`."""
        return self._longest(lambda n: self.equal(a - n, b - n, n), most)

    def hashes(self, a: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """The hashes of the spans, moved to place 0, so that equal content anywhere has equal hashes."""
        out = []
        for m, (base, p) in enumerate(zip(BASES, PRIMES)):
            back = pow(base, -1, p)
            out.append(self._span(m, a, n) * np.array([pow(back, int(x), p) for x in a], np.uint64) % np.uint64(p))
        return out

    def joined(self, a: np.ndarray, n: np.ndarray, b: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """The hashes of the n places from a followed by the k from b."""
        x, y = self.hashes(a, n), self.hashes(b, k)
        return [(x[m] + y[m] * self.powers[m][n] % np.uint64(PRIMES[m])) % np.uint64(PRIMES[m]) for m in (0, 1)]


def _named(n: np.ndarray, hashes: list[np.ndarray]) -> list[str]:
    return [f"{k:x}-{x:08x}{y:08x}" for k, x, y in zip(n.tolist(), hashes[0].tolist(), hashes[1].tolist())]


def _likeness(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of the longer text that the common prefix and the common suffix (of what is left) cover; 1 for two empty ones."""
    most = np.maximum(n, m)
    covered = prefix + np.minimum(suffix, np.minimum(n, m) - prefix)
    return np.where(most > 0, covered / np.maximum(most, 1), 1.0)


def compare_pairs(texts: list[str]) -> tuple[list[str], list[str], list[str], np.ndarray, np.ndarray]:
    """For each text but the last, with the text after it: its fingerprint; its edited text, whose last half of code points
    gives way to the first as many of the next text; the edited text's fingerprint; likeness to the edited and to the next
    text. All of it is answered from one prefix array: no edited text is hashed or compared itself."""
    h = PrefixHashes(texts)
    a, b, end = h.bounds[:-2], h.bounds[1:-1], h.bounds[2:]
    n, m = b - a, end - b
    half = n // 2
    kept, taken = n - half, np.minimum(half, m)
    size = kept + taken
    fingerprints = _named(n, h.hashes(a, n))
    edited_prints = _named(size, h.joined(a, kept, b, taken))
    edited = [t[:k] + u[:g] for t, u, k, g in zip(texts, texts[1:], kept.tolist(), taken.tolist())]
    # own text and edited text: the kept part is common, then the next text's beginning stands against the second half
    prefix = kept + h.forwards(a + kept, b, taken)
    suffix = h.backwards(b, b + taken, taken)
    whole = suffix == taken  # the taken part is all common: on into the kept part, which stands `half - taken` places earlier
    suffix = suffix + h.backwards(b - taken, a + kept, np.where(whole, kept, 0))
    near_edited = _likeness(prefix, suffix, n, size)
    least = np.minimum(n, m)
    near_next = _likeness(h.forwards(a, b, least), h.backwards(b, end, least), n, m)
    return fingerprints, edited, edited_prints, near_edited, near_next


KEY = "struct<last: boolean, at: bigint, h: bigint>"


def _listed(heads: list) -> Column:
    """The heads as one text that Spark folds into a constant: an expression for each number would take long to plan."""
    return F.from_json(F.lit(json.dumps([h.asDict() for h in heads])), f"array<{KEY}>")


def _bucket(key: Column, heads: list) -> Column:
    """The number of the last of the ascending heads that is at or below key, by binary search within the expression."""
    bounds, steps = _listed(heads), max(1, len(heads).bit_length())
    weights = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])

    def step(found: Column, w: Column) -> Column:
        # try_element_at counts from 1: found + w is the place of head number found + w - 1
        head = F.try_element_at(bounds, found + w)
        return F.when((found + w <= len(heads)) & (head <= key), found + w).otherwise(found)

    return F.aggregate(weights, F.lit(0), step) - 1


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def fingerprint_neighbours(df: DataFrame, *, doc: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_chars, fingerprint, edited (the edited text), edited_fingerprint, near_edited
    and near_next, as compare_pairs has them with the next row's text.

    Rows are in descending order of their document ids, null ids last; rows of equal ids, by a hash of their texts, then
    by text. The first row comes after the last. Null texts are empty; two empty texts are alike. Other columns of df
    have no part in it; an empty df gives no rows.

    The order is dealt to ranges by ids and hashes alone (a first pass, which finds the head of each range); then the texts
    are shuffled once, and each range also gets the head of the next one, so that no row waits for another task.
    """
    import pyarrow as pa

    spark = df.sparkSession
    ship(spark)
    base = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("doc", "text", F.struct(F.col("doc").isNull().alias("last"), F.coalesce(F.bitwise_not("doc"), F.lit(0)).alias("at"), F.xxhash64("text").alias("h")).cast(KEY).alias("key"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = base.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("head"))
    heads = sorted(r["head"] for r in ranges.collect())  # one for each range, whose number is that of the shuffle's partitions
    if not heads:
        return spark.createDataFrame([], OUT)
    placed = base.withColumn("bucket", _bucket(F.col("key"), heads))
    head_of = F.element_at(_listed(heads), F.col("bucket") + 1)
    guests = placed.where(F.col("key") == head_of).groupBy("bucket").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc"), "text", F.lit(None).cast(placed.schema["key"].dataType).alias("key"), F.pmod(F.col("bucket") - 1, F.lit(len(heads))).alias("bucket"), F.lit(True).alias("guest"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = both.repartitionById(len(heads), "bucket").sortWithinPartitions("bucket", "guest", "key", "text").select("doc", "text", "guest")

    def run(batches):
        carried = None  # the row that waits for the next one: (doc, text)
        for big in batches:
            for batch in slices(big):
                docs, texts, guest = batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist()
                if carried is not None:
                    docs.insert(0, carried[0]), texts.insert(0, carried[1]), guest.insert(0, False)
                carried = None if guest[-1] else (docs[-1], texts[-1])
                if len(texts) < 2:
                    continue
                prints, edited, edited_prints, near, next_near = compare_pairs(texts)
                own = ~np.array(guest[:-1], bool)  # a guest is the next row of another, and no row itself here
                columns = [pa.array(docs[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(prints), pa.array(edited, pa.string()), pa.array(edited_prints), pa.array(near), pa.array(next_near)]
                yield pa.RecordBatch.from_arrays(columns, OUT.names).filter(pa.array(own))

    return dealt.mapInArrow(run, OUT)


def common_spans(df: DataFrame, left: str, left_at: str, right: str, right_at: str, length: str, *, names: tuple[str, str, str] = ("same", "forwards", "backwards")) -> DataFrame:
    """df with three columns more: whether the spans of `length` code points from (0-based) left_at and right_at of two text
    columns are equal; the longest common extension from these places on; that before them.

    A span that leaves its text, and a null anywhere, gives null. Columns of df with these names are replaced.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    held = df.drop(*names)
    inner = held.select(F.struct(*held.columns).alias("row"), F.col(left).alias("a"), F.col(right).alias("b"), *[F.col(c).cast("long").alias(x) for c, x in ((left_at, "i"), (right_at, "j"), (length, "n"))])
    schema = T.StructType([inner.schema["row"], T.StructField("same", T.BooleanType()), T.StructField("forwards", T.LongType()), T.StructField("backwards", T.LongType())])

    def run(batches):
        for big in batches:
            for batch in slices(big, "a", "b"):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                i, j, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("i", "j", "n"))
                h = PrefixHashes([t or "" for pair in zip(a, b) for t in pair])
                x, y, end = h.bounds[:-1:2], h.bounds[1::2], h.bounds[2::2]
                there = np.array([s is not None and t is not None for s, t in zip(a, b)], bool)
                good = there & (i >= 0) & (j >= 0) & (i <= y - x) & (j <= end - y)
                i, j = np.where(good, i, 0).astype(np.int64), np.where(good, j, 0).astype(np.int64)
                fits = good & (n >= 0) & (n <= np.minimum(y - x - i, end - y - j))
                same = h.equal(x + i, y + j, np.where(fits, n, 0).astype(np.int64))
                ahead = h.forwards(x + i, y + j, np.minimum(y - x - i, end - y - j))
                before = h.backwards(x + i, y + j, np.minimum(i, j))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(same, mask=~fits), pa.array(ahead, mask=~good), pa.array(before, mask=~good)], schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select("row.*", *[F.col(c).alias(x) for c, x in zip(("same", "forwards", "backwards"), names, strict=True)])
