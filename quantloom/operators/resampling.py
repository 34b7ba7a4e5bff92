"""Block bootstrap: intervals of means of time series whose values hang on each other.

Dates are dealt to blocks of neighbours. In each replicate a block counts as often as a Poisson draw says, which comes from
a hash of seed, replicate and block alone: every replicate is worked out in the same pass over the blocks' sums, whatever
the partitioning, and all series of a date are drawn together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import null_nan


def poisson_limits(mean: float = 1.0) -> list[int]:
    """The 32-bit numbers from which on a uniform one counts once, twice and so on."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        limit = round(total * 2**32)
        if limit >= 2**32:
            return out
        out.append(limit)
        k += 1
        term *= mean / k


def draws(seed: int, replicate: Column, block: Column) -> Column:
    """How often a block counts in a replicate: the first 32 bits of a digest against the limits of a Poisson draw."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), block.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return sum(((u >= x).cast("int") for x in poisson_limits()[1:]), (u >= poisson_limits()[0]).cast("int"))


def block_bootstrap(series: DataFrame, value: str, *, by: str = "factor", block: int = 20, replicates: int = 1_000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """by, n, mean, error (deviation of the replicates' means), low and high (their quantiles around `level`).

    Blocks are of `block` dates that follow each other among all dates of the series; missing values are left out. A
    replicate that draws nothing of a series has no mean.
    """
    if block < 1 or replicates < 2 or not 0 < level < 1:
        raise ValueError("block must be at least 1, replicates at least 2, level between 0 and 1")
    own = series.select(by, "Date", null_nan(F.col(value).cast("double")).alias("v")).where("v is not null and Date is not null")
    calendar = own.select("Date").distinct()
    calendar = calendar.select("Date", F.floor((F.row_number().over(Window.orderBy("Date")) - 1) / block).alias("block"))  # a row a date
    sums = own.join(calendar, "Date").groupBy(by, "block").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    drawn = sums.select(by, "block", "n", "s", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("w", draws(seed, F.col("replicate"), F.col("block"))).where("w > 0")
    means = drawn.groupBy(by, "replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    edge = (1 - level) / 2
    told = means.groupBy(by).agg(F.stddev_samp("mean").alias("error"), F.percentile("mean", F.lit(edge)).alias("low"), F.percentile("mean", F.lit(1 - edge)).alias("high"))
    return sums.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")).join(told, by, "left").select(by, "n", "mean", "error", "low", "high")
