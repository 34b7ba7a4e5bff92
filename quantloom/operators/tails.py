"""Exact quantiles of any number of rows by selection, and what lies beyond them: tail expectation and Cornish-Fisher.

Selection narrows an interval of values around each wanted rank: a pass counts the values of an interval by equal parts and
goes on with the part that holds the rank, until few values are left, or equal ones. Nothing is sorted as a whole, and no
task holds more than counts; a pass sends back a row for each part and task that has any.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import null_nan
from ..sources.scratch import stored

#: Equal parts of an interval.
PARTS = 4_096
#: An interval of at most so many values is read as it is.
FEW = 10_000


def exact_quantiles(df: DataFrame, names: Sequence[str], levels: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column the quantiles at levels, interpolated between neighbouring ranks; NULL and NaN don't count, None where
    a column holds nothing else."""
    if any(isinstance(q, bool) or not 0 <= q <= 1 for q in levels):
        raise ValueError("levels must be between 0 and 1")
    held = stored(df.select(*[null_nan(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(names)]), "values")
    facts = held.agg(*[x for i in range(len(names)) for x in (F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"a{i}"), F.max(f"c{i}").alias(f"z{i}"))]).first()
    ranks = lambda n: sorted({k for q in levels for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    # (column, rank): [low, high, values below low, values within]
    open_ = {(i, k): [facts[f"a{i}"], facts[f"z{i}"], 0, facts[f"n{i}"]] for i in range(len(names)) if facts[f"n{i}"] for k in ranks(facts[f"n{i}"])}
    found: dict[tuple[int, int], float] = {}
    while open_:
        for key in [key for key, (low, high, _, _) in open_.items() if low == high]:
            found[key] = open_.pop(key)[0]
        wide = sorted({(i, v[0], v[1], v[3]) for (i, _), v in open_.items()})
        if not wide:
            break
        # of each row, the intervals that its values lie in
        within = lambda i, low, high: (F.col(f"c{i}") >= low) & (F.col(f"c{i}") <= high)
        part = lambda i, low, high: F.least(F.floor((F.col(f"c{i}") / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1)).cast("int") if high / 2 > low / 2 else F.lit(0)
        read = [n <= FEW for *_, n in wide]
        marks = F.array(*[F.when(within(i, low, high), F.struct(F.lit(w).alias("w"), F.lit(0).alias("part") if read[w] else part(i, low, high).alias("part"), F.col(f"c{i}").alias("x"))) for w, (i, low, high, _) in enumerate(wide)])
        rows = held.select(F.explode(marks).alias("m")).where("m is not null").select("m.*")
        values: dict[int, list] = {}
        if any(read):
            few = rows.where(F.col("w").isin([w for w in range(len(wide)) if read[w]]))
            for r in few.select("w", "x").collect():  # FEW for each interval
                values.setdefault(r["w"], []).append(r["x"])
        parts: dict[int, list] = {}
        if not all(read):
            many = rows.where(F.col("w").isin([w for w in range(len(wide)) if not read[w]]))
            for r in many.groupBy("w", "part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():  # PARTS for each interval
                parts.setdefault(r["w"], []).append((r["part"], r["n"], r["low"], r["high"]))
        number = {v[:3]: w for w, v in enumerate(wide)}
        for (i, k), state in list(open_.items()):
            w = number[i, state[0], state[1]]
            if read[w]:
                found[i, k] = sorted(values[w])[k - state[2]]
                del open_[i, k]
                continue
            below = state[2]
            for _, n, low, high in sorted(parts[w]):
                if k < below + n:
                    open_[i, k] = [low, high, below, n]
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n = facts[f"n{i}"]
        row = []
        for q in levels:
            if not n:
                row.append(None)
                continue
            at = q * (n - 1)
            a, z = found[i, math.floor(at)], found[i, math.ceil(at)]
            row.append(a if a == z else a + (at - math.floor(at)) * (z - a))
        out[c] = row
    return out


def cornish_fisher(z: float, skewness, excess):
    """The normal quantile z with skewness and excess kurtosis put right; numbers or columns."""
    return z + (z**2 - 1) / 6 * skewness + (z**3 - 3 * z) / 24 * excess - (2 * z**3 - 5 * z) / 36 * skewness * skewness


def tail_risk(df: DataFrame, names: Sequence[str], level: float = 0.05) -> DataFrame:
    """name, n, value_at_risk (minus the quantile at level), tail_expectation (minus the mean of the values at or below it),
    normal_var and modified_var (by moments, without and with Cornish-Fisher's correction), skewness and excess kurtosis of
    each column of returns; NULL where there is no dispersion."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    quantile = {c: q[0] for c, q in exact_quantiles(df, names, [level]).items()}
    z = NormalDist().inv_cdf(level)
    value = {c: null_nan(F.col(f"`{c}`").cast("double")) for c in names}
    sums = []
    for i, c in enumerate(names):
        v = value[c]
        tail = F.avg(F.when(v <= quantile[c], v)) if quantile[c] is not None else F.lit(None).cast("double")
        sums += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.skewness(v).alias(f"k{i}"), F.kurtosis(v).alias(f"x{i}"), tail.alias(f"t{i}"), (F.min(v) < F.max(v)).alias(f"d{i}")]
    row = df.agg(*sums)
    varied = lambda i, c: F.when(F.col(f"d{i}"), c)
    one = lambda i, c: F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.lit(None if quantile[c] is None else -quantile[c]).cast("double").alias("value_at_risk"), (-F.col(f"t{i}")).alias("tail_expectation"), (-(F.col(f"m{i}") + z * F.col(f"s{i}"))).alias("normal_var"), varied(i, -(F.col(f"m{i}") + F.col(f"s{i}") * cornish_fisher(z, F.col(f"k{i}"), F.col(f"x{i}")))).alias("modified_var"), varied(i, F.col(f"k{i}")).alias("skewness"), varied(i, F.col(f"x{i}")).alias("excess_kurtosis"))
    return row.select(F.inline(F.array(*[one(i, c) for i, c in enumerate(names)])))
