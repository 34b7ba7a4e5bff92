"""Fama-MacBeth: rolling time-series betas of each ticker, then each date's regression of returns on them.

The first pass keeps running sums of products by ticker; a window's co-moments are differences of two of them, so its cost
doesn't grow with the window. The second pass is the cross-sectional regression of the risk model, and the premia's t
values are Newey-West's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.expressions import KEYS, by_ticker, null_nan
from ..functions.shipping import ship
from ..sources.scratch import join_measured, stored
from .risk import factor_returns, least_norm
from .validation import newey_west


def rolling_betas(returns: DataFrame, factors: DataFrame, names: Sequence[str], *, window: int = 252, least: int | None = None, value: str = "r") -> DataFrame:
    """Date, Ticker, value and a column for each factor: slopes of the ticker's regression (with a constant) of its returns
    on the factors' over the `window` rows before this one, this one not included.

    Rows count that have the return and all factors of their date; slopes are NULL with fewer than `least` (window) such
    rows. Factors (Date and names) must have each date once.
    """
    least = window if least is None else least
    if window < len(names) + 2 or least < len(names) + 2:
        raise ValueError("a window must have at least two rows more than factors")
    spark, k = returns.sparkSession, len(names)
    ship(spark)
    own = factors.select("Date", *[null_nan(F.col(n).cast("double")).alias(f"__f{i}") for i, n in enumerate(names)])
    held = join_measured(returns.select(*KEYS, null_nan(F.col(value).cast("double")).alias("__r")), own, ["Date"])
    f = [F.col(f"__f{i}") for i in range(k)]
    whole = F.col("__r").isNotNull()
    for c in f:
        whole = whole & c.isNotNull()
    counted = lambda c: F.when(whole, c).otherwise(0.0)
    parts = {"n": F.lit(1.0), "r": F.col("__r")} | {f"f{i}": f[i] for i in range(k)} | {f"fr{i}": f[i] * F.col("__r") for i in range(k)} | {f"ff{i}_{j}": f[i] * f[j] for i in range(k) for j in range(i, k)}
    past = by_ticker().rowsBetween(Window.unboundedPreceding, -1)
    sums = held.select(*KEYS, "__r", *[F.coalesce(F.sum(counted(c)).over(past), F.lit(0.0)).alias(f"__s_{n}") for n, c in parts.items()])
    sums = sums.select(*KEYS, "__r", F.array(*[F.col(f"__s_{n}") - F.coalesce(F.lag(f"__s_{n}", window).over(by_ticker()), F.lit(0.0)) for n in parts]).alias("s"))
    order = {n: i for i, n in enumerate(parts)}

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            s = np.array(pdf["s"].tolist(), float).reshape(len(pdf), len(order))
            n = s[:, order["n"]]
            enough = n >= least - 0.5
            safe = np.where(enough, n, 1.0)
            mean = np.stack([s[:, order[f"f{i}"]] / safe for i in range(k)], axis=1)
            gram, b = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k))
            for i in range(k):
                b[:, i] = s[:, order[f"fr{i}"]] - mean[:, i] * s[:, order["r"]]
                for j in range(i, k):
                    gram[:, i, j] = gram[:, j, i] = s[:, order[f"ff{i}_{j}"]] - mean[:, i] * mean[:, j] * safe
            beta = np.full((len(pdf), k), np.nan)
            if enough.any():
                beta[enough] = least_norm(gram[enough], b[enough])
            out = pd.DataFrame(beta, columns=list(names))
            for c in ("Ticker", "Date"):
                out.insert(0, c, pdf[c].to_numpy())
            out.insert(2, "__r", pdf["__r"].to_numpy())
            yield out

    schema = T.StructType([returns.schema["Date"], returns.schema["Ticker"], T.StructField("__r", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    out = sums.mapInPandas(solve, schema)
    return out.select(*KEYS, null_nan(F.col("__r")).alias(value), *[null_nan(F.col(n)).alias(n) for n in names])


def fama_macbeth(returns: DataFrame, factors: DataFrame, names: Sequence[str], *, window: int = 252, least: int | None = None, lags: int = 5, value: str = "r") -> dict[str, DataFrame]:
    """betas (as rolling_betas), premia (Date, const and a column for each factor: that date's regression of returns on the
    betas known before it) and summary (factor, n_dates, premium, nw_t)."""
    betas = stored(rolling_betas(returns, factors, names, window=window, least=least, value=value), "betas")
    aligned = betas.withColumnRenamed(value, "r").dropna("any", subset=["r", *names]) if value != "r" else betas.dropna("any", subset=["r", *names])
    premia = stored(factor_returns(aligned, names, intercept=True), "premia")
    long = premia.unpivot(["Date"], ["const", *names], "factor", "premium")
    means = long.groupBy("factor").agg(F.count("premium").alias("n_dates"), F.avg("premium").alias("premium"))
    return {"betas": betas, "premia": premia, "summary": means.join(newey_west(long, "premium", lags), "factor", "left")}
