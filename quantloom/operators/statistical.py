"""Statistical factors: principal components of a panel of returns, by a randomized block Krylov iteration over its rows.

The returns are never laid out as a matrix: a pass multiplies by it or by its transpose as a join with a few numbers for
each date or ticker and an aggregate. What is of the size of the tickers (loadings) stays a DataFrame; what is of the size
of the dates comes to the driver as blocks of a few columns, which are made orthonormal there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.expressions import null_nan
from ..sources.scratch import join_measured, stored


@dataclass(frozen=True)
class StatisticalFactors:
    """loadings (Ticker, factor, loading; unit columns), spectrum (factor, variance, share) and scores (Date, factor, score)."""

    loadings: DataFrame
    spectrum: DataFrame
    scores: DataFrame


def _block(spark, dates: list, z: np.ndarray, kind: T.DataType) -> DataFrame:
    """Date and z, its row of numbers."""
    schema = T.StructType([T.StructField("Date", kind), T.StructField("z", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame([(d, row.tolist()) for d, row in zip(dates, z, strict=True)], schema)


def statistical_factors(returns: DataFrame, factors: int = 5, *, value: str = "r", correlation: bool = False, extra: int = 8, passes: int = 40, tolerance: float = 1e-12, seed: int = 0, most_dates: int = 50_000) -> StatisticalFactors:
    """The leading components of the covariance of returns (Date, Ticker, value), numbered from 1.

    Each ticker is centred by the mean of its values (correlation: and divided by its deviation; one without dispersion is
    left out); a missing value then counts as 0. `extra` directions more than asked for are carried along; iteration ends
    when the leading variances no longer change, or after `passes`. The sign of a component is that of its largest loading
    (of equal ones the first ticker's). ValueError for more than most_dates dates, or if there is nothing to decompose.
    """
    spark, kind = returns.sparkSession, returns.schema["Date"].dataType
    own = returns.select("Date", "Ticker", null_nan(F.col(value).cast("double")).alias("v")).where("v is not null and Date is not null and Ticker is not null")
    centre = own.groupBy("Ticker").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), (F.min("v") < F.max("v")).alias("varied"))
    x = F.col("v") - F.col("m")
    rows = join_measured(own, centre.where("varied") if correlation else centre, ["Ticker"], "inner")
    rows = stored(rows.select("Date", "Ticker", (x / F.col("s") if correlation else x).alias("x")), "centred")
    dates = [r["Date"] for r in rows.select("Date").distinct().orderBy("Date").limit(most_dates + 1).collect()]
    if len(dates) > most_dates:
        raise ValueError(f"there are more than {most_dates} dates")
    total = rows.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    if len(dates) < 2 or not total:
        raise ValueError("there is no dispersion to decompose")
    size = min(factors + extra, len(dates))
    kept = min(factors, size)
    place = {d: i for i, d in enumerate(dates)}

    def loadings_of(z: np.ndarray) -> DataFrame:
        """The transpose times a block of the dates: a row for each ticker."""
        sent = F.broadcast(_block(spark, dates, z, kind))  # dates times a few numbers
        return stored(rows.join(sent, "Date").groupBy("Ticker").agg(*[F.sum(F.col("x") * F.col("z")[i]).alias(f"b{i}") for i in range(z.shape[1])]), "loadings")

    def twice(z: np.ndarray) -> np.ndarray:
        """The returns times their transpose times a block."""
        each = join_measured(rows, loadings_of(z), ["Ticker"], "inner").groupBy("Date").agg(F.array(*[F.sum(F.col("x") * F.col(f"b{i}")) for i in range(z.shape[1])]).alias("y")).collect()
        y = np.zeros_like(z)
        for r in each:
            y[place[r["Date"]]] = r["y"]
        return y

    # all blocks so far span the space in which the components are sought: far fewer passes than the last block alone takes
    z, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(dates), size)))
    basis, images, before = z, np.zeros((len(dates), 0)), None
    for _ in range(passes):
        images = np.hstack((images, twice(z)))
        h = basis.T @ images
        values, turn = np.linalg.eigh((h + h.T) / 2)
        lead, turn = np.maximum(values[::-1][:kept], 0), turn[:, ::-1][:, :kept]
        if basis.shape[1] == len(dates) or (before is not None and np.abs(lead - before).max() <= tolerance * lead[0]):
            break
        before = lead
        z = images[:, -z.shape[1] :]
        for _again in range(2):  # twice is enough for orthogonality
            z = z - basis @ (basis.T @ z)
        z, weight, _ = np.linalg.svd(z, full_matrices=False)
        z = z[:, weight > 1e-12 * max(lead[0], 1e-300)][:, : len(dates) - basis.shape[1]]
        if not z.shape[1]:
            break
        basis = np.hstack((basis, z))
    root = np.sqrt(lead)
    there = lead > 1e-14 * max(lead[0], 1e-300)
    found = basis @ turn  # scores of unit length
    b = loadings_of(found[:, there])
    columns = [F.col(f"b{i}") / float(r) for i, r in enumerate(root[there])]
    raw = b.select("Ticker", F.posexplode(F.array(*columns)).alias("k", "loading"))
    signs = {r["k"]: 1.0 if r["l"] >= 0 else -1.0 for r in raw.groupBy("k").agg(F.min_by("loading", F.struct(-F.round(F.abs("loading"), 9), "Ticker")).alias("l")).collect()}
    sign = F.element_at(F.array(*[F.lit(signs[k]) for k in range(len(columns))]), F.col("k") + 1)
    loadings = raw.select("Ticker", (F.col("k") + 1).alias("factor"), (F.col("loading") * sign).alias("loading"))
    spectrum = spark.createDataFrame([(k + 1, float(lead[k] / (len(dates) - 1)), float(lead[k] / total)) for k in range(kept)], "factor int, variance double, share double")
    scores = found * root
    listed = [(d, k + 1, float(scores[t, k] * signs[k])) for t, d in enumerate(dates) for k in range(len(columns))]
    return StatisticalFactors(loadings, spectrum, spark.createDataFrame(listed, T.StructType([T.StructField("Date", kind), T.StructField("factor", T.IntegerType()), T.StructField("score", T.DoubleType())])))
