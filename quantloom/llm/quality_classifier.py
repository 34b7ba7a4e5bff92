"""Operator 3, quality classifier: ordinal cumulative-link regression on graded ratings.

A document's ratings add up to a grade 0 .. top. One vector of weights over hashed features of the text gives a score s,
shared by all grades, and ordered thresholds t_1 < t_2 < ... cut it:  P(grade >= k) = 1 / (1 + exp(t_k - s)).  The expected
grade is the sum of these tail probabilities, and selection asks for a least tail probability.

Fitting takes a bounded sample of the rated rows (FIT_ROWS, those of the smallest hashed ids, with FIT_FEATURES features
at the most), whose features come to the driver as numbers; scoring runs over all documents in tasks, a batch of whole
texts at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, Words, mix, ship, slices, text_buffer

#: Hashed features: 2**BITS weights.
BITS = 18
#: The most rated rows that the fit sees, each with all its features, and the most features of all of them together.
FIT_ROWS, FIT_FEATURES = 8_000, 16_000_000
LASSO = 0.8
#: Rows of the sample that a feature must be in to get a weight.
FIT_LEAST = 5
#: Longer words also count by so many of their first bytes.
PREFIXES = (6,)
STEPS = 120
RATE = 0.05
RIDGE = 1e-4
#: The least probability of the top grade with which a document is kept.
LEAST = 0.5

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_BLANK = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, list(b".,;:'\"-()"))
_LOUD = np.isin(_BYTES, list(b"!?"))
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOP | _LOUD)
#: Shares are told in steps of a fifth of an e-fold below one.
_STEPS_OF_SHARE = 24


def _step(share: np.ndarray) -> np.ndarray:
    """0 for none, then steps that grow with the share."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.clip(_STEPS_OF_SHARE + np.floor(4 * np.log(share)), 1, _STEPS_OF_SHARE), 0).astype(np.uint64)


def _doubled(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values of each row were in it before."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[again], minlength=n)


def _numbers(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashed features of a batch of texts, each feature of a row once, ordered by both.

    Features are the words (runs of letters, A-Z lowered), the first PREFIXES bytes of longer ones, and steps of what
    shares capitals, digits, signs and repeated words and lines have.
    """
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    w = Words(column, lower=True, apart=~_LETTER)
    codes, words = w.coded()
    hashes, counts = _numbers(words)[codes], np.diff(w.bounds)
    row = np.repeat(np.arange(n), counts)
    size = np.maximum(np.diff(offsets), 1)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    beside = np.zeros(len(hashes), bool)
    beside[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = Words(column, apart=newline)
    n_lines = np.diff(lines.bounds)
    shares = [bytes_in(k) / size for k in (_UPPER, _DIGIT, _LOUD, _SYMBOL)]
    shares.append(np.bincount(row[beside], minlength=n) / np.maximum(counts, 1))
    shares.append(_doubled(np.repeat(np.arange(n), n_lines), lines.hashes(), n) / np.maximum(n_lines, 1))
    marks = np.concatenate([mix(_step(s) + np.uint64(1 + 1000 * i)) for i, s in enumerate(shares)])
    heads = []
    for k in PREFIXES:
        longer = w.ends - w.starts > k
        heads.append((row[longer], mix(_numbers([x[:k] for x in words])[codes[longer]] + np.uint64(k))))
    rows = np.concatenate((row, *(r for r, _ in heads), np.tile(np.arange(n), len(shares)))).astype(np.uint64)
    keys = np.unique(rows << np.uint64(bits) | np.concatenate((hashes, *(h for _, h in heads), marks)) >> np.uint64(64 - bits))
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass(frozen=True)
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[hashed], n)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rows: np.ndarray, hashed: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS) -> CumulativeLink:
    """By the likelihood of the grades, in full steps of Adam; no rows: all even.

    First with a lasso that grows with a feature's standard error, so that chance leaves no weight; then the features
    left are fitted again with a ridge alone.
    """
    n, top = len(grades), n_grades - 1
    if not n:
        return CumulativeLink(np.zeros(1 << bits, np.float32), np.zeros(top))
    seen = np.bincount(hashed, minlength=1 << bits)
    used = np.flatnonzero(seen >= min(FIT_LEAST, n))
    place = np.full(1 << bits, -1)
    place[used] = np.arange(len(used))
    place = place[hashed]
    rows, place = rows[place >= 0], place[place >= 0]
    # thresholds as a first one and logarithms of the gaps, so that they stay in order
    share = np.clip([np.mean(grades >= k) for k in range(1, n_grades)], 0.5 / n, 1 - 0.5 / n)
    first = np.sort(np.log((1 - share) / share))
    x = np.concatenate((np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    noise = LASSO * np.sqrt(seen[used]) / n
    at_top, at_floor = grades == top, grades == 0
    for step in range(1, 2 * STEPS + 1):
        w, t = x[: len(used)], np.cumsum(np.concatenate((x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :]))))
        s = np.bincount(rows, w[place], n)
        sig = lambda z: 1 / (1 + np.exp(np.clip(-z, -500, 500)))
        low = np.where(at_floor, 1.0, sig(s - t[np.maximum(grades - 1, 0)]))  # P(grade >= own)
        high = np.where(at_top, 0.0, sig(s - t[np.minimum(grades, top - 1)]))  # P(grade > own)
        p = np.maximum(low - high, 1e-12)
        dlow, dhigh = np.where(at_floor, 0.0, low * (1 - low)) / p, np.where(at_top, 0.0, high * (1 - high)) / p
        ds = dhigh - dlow  # of minus the log likelihood, by the score
        dt = np.array([np.sum(dlow[grades == k + 1]) - np.sum(dhigh[grades == k]) for k in range(top)]) / n
        gap = np.exp(x[len(used) + 1 :])
        tails = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate((np.bincount(place, ds[rows], len(used)) / n + RIDGE * w, tails[:1], tails[1:] * gap))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x = x - pace * m / (1 - 0.9**step)
        own = x[: len(used)]
        if step <= STEPS:
            own[:] = np.sign(own) * np.maximum(np.abs(own) - pace[: len(used)] * noise, 0)
        else:
            own[~chosen] = 0
        if step == STEPS:
            chosen = own != 0
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = x[: len(used)]
    return CumulativeLink(weights, np.cumsum(np.concatenate((x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :])))))


def _ratings_grade(labels: DataFrame, good: str, bad: str) -> Column:
    """quality 0/1 and toxic 0/1 as a grade: 2 for good and not toxic, 1 for one of both, 0 for neither."""
    return (F.col(good) + 1 - F.col(bad)).cast("int")


def rated_sample(labels: DataFrame, *, doc: str = "doc_id", good: str = "quality", bad: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """doc and grade of at most `rows` rated documents: those of the smallest hashed ids. Of several ratings the lowest counts;
    rows without an id or a rating don't."""
    grades = labels.select(F.col(doc).cast("long").alias("doc"), _ratings_grade(labels, good, bad).alias("grade")).where("doc is not null and grade between 0 and 2").groupBy("doc").agg(F.min("grade").alias("grade"))
    n = grades.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc"), 1)
    about = math.ceil(rows + 6 * rows**0.5)
    if n > about:  # first by a threshold in each task, so that few more than `rows` meet
        grades = grades.where(draw <= F.lit((2**63 - 1) * about // n))
    return grades.orderBy(draw, "doc").limit(rows)


def fit_documents(df: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", good: str = "quality", bad: str = "toxic", rows: int = FIT_ROWS, most: int = FIT_FEATURES, bits: int = BITS) -> CumulativeLink:
    """A model of the rated documents of df. The sample's ids (at most `rows`, 16 bytes each) are broadcast; its features
    come to the driver, one row for each id, all numbers below 2**bits: whole rows in the order of the hashed ids, as
    long as they have no more than `most` features together. A null text has no features but those of an empty one; of
    several rows with one id one is taken, the same each time."""
    import pyarrow as pa

    spark = df.sparkSession
    ship(spark)
    rated = F.broadcast(rated_sample(labels, doc=doc, good=good, bad=bad, rows=rows))
    own = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).join(rated, "doc")

    def run(batches):
        for big in batches:
            for batch in slices(big):
                row, hashed = features(batch.column("text"), bits)
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                lists = [hashed[a:z].astype(np.int32) for a, z in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("grade"), pa.array(lists, pa.list_(pa.int32()))], ["doc", "grade", "features"])

    scratch = Scratch(spark)
    found = own.mapInArrow(run, "doc long, grade int, features array<int>").groupBy("doc").agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
    found = scratch.written(found, "features")
    total, within = 0, []
    for r in found.select("doc", F.size("features").alias("n")).orderBy(F.shiftrightunsigned(F.xxhash64("doc"), 1), "doc").collect():  # `rows` at the most
        total += r["n"]
        if total > most:
            found = found.where(F.col("doc").isin(within))
            break
        within.append(r["doc"])
    found = found.toArrow()
    scratch.drop("features")
    order = np.argsort(np.asarray(found["doc"]), kind="stable")  # the same order whatever task was first
    lists = found["features"].combine_chunks().take(pa.array(order))
    grades = np.asarray(found["grade"])[order].astype(np.int64)
    counts = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
    return fit(np.repeat(np.arange(len(grades)), counts), np.asarray(lists.flatten()).astype(np.int64), grades, 3, bits)


def grade_documents(df: DataFrame, model: CumulativeLink, *, doc: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, p_1, p_2 .. (probabilities of that grade or a higher one) and kept (the last is `least` or more).

    One row for each row of df, whatever its id; a null text is judged like an empty one. Other columns have no part.
    """
    import pyarrow as pa

    spark, bits = df.sparkSession, int(len(model.weights)).bit_length() - 1
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [f"p_{k + 1}" for k in range(len(model.thresholds))]

    def run(batches):
        for big in batches:
            for batch in slices(big):
                above = sent.value.above(sent.value.score(*features(batch.column("text"), bits), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(above.sum(axis=1)), *[pa.array(a.copy()) for a in above.T], pa.array(above[:, -1] >= least)], ["doc_id", "expected_grade", *names, "kept"])

    schema = "doc_id long, expected_grade double, " + ", ".join(f"{n} double" for n in names) + ", kept boolean"
    return df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def keep_top(df: DataFrame, model: CumulativeLink, *, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of df whose top grade is likely enough, with all their columns as they are.

    Each row is judged by its text alone, whatever its id: a null text like an empty one, repeated rows alike, texts of any
    length whole. No column is added, so that none can clash. An empty df gives no rows."""
    spark, bits = df.sparkSession, int(len(model.weights)).bit_length() - 1
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in slices(big, text):
                above = sent.value.above(sent.value.score(*features(batch.column(text), bits), batch.num_rows))
                yield batch.filter(pa.array(above[:, -1] >= least))

    return df.mapInArrow(run, df.schema)
