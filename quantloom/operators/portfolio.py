"""Portfolios: minimum variance under a box, simulation, turnover, tear sheet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import by_ticker, safe_div


def sample_covariance(eps: DataFrame, tickers: Sequence[str], annualization: int = 252) -> np.ndarray:
    """Annualized sample covariance of the named tickers' residuals, a missing one being 0. One row of moments comes back."""
    wide = eps.where(F.col("Ticker").isin(*tickers)).groupBy("Date").agg(*[F.coalesce(F.max(F.when(F.col("Ticker") == t, F.col("eps"))), F.lit(0.0)).alias(f"x{i}") for i, t in enumerate(tickers)])
    n = len(tickers)
    row = wide.agg(*[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    return annualization * np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)


def _onto_box(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights that sum to 1 within [0, cap]."""
    low, high = v.min() - cap - 1, v.max() + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - (low + high) / 2, 0, cap)


def min_variance(cov: np.ndarray, cap: float = 0.30, steps: int = 20_000, least: float = 1e-4) -> np.ndarray:
    """Weights of least variance with sum 1 and 0 <= w <= cap, by accelerated projected gradients; dust goes to 0."""
    n = len(cov)
    if cap * n < 1:
        raise ValueError("cap is too small for the number of assets")
    rate = 1 / max(float(np.linalg.eigvalsh(cov)[-1]), 1e-300)
    w = y = np.full(n, 1 / n)
    t = 1.0
    for _ in range(steps):
        new = _onto_box(y - rate * (cov @ y), cap)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - w)
        moved, w = float(np.abs(new - w).max()), new
        if moved < 1e-14:
            break
    return np.where(w < least, 0.0, w)


def simulate(spark, cov: np.ndarray, weights: np.ndarray, *, simulations: int = 10_000, days: int = 252, seed: int = 42, annualization: int = 252) -> DataFrame:
    """sim, ret: total returns of correlated normal daily returns; each block of simulations has a seed of its own, so a
    task that runs again gives the same rows."""
    root = np.linalg.cholesky(cov / annualization)
    block = 250

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for b in pdf["id"].tolist():
                n = min(block, simulations - b * block)
                z = np.random.default_rng([seed, int(b)]).standard_normal((n, days, len(weights)))
                daily = (z @ root.T) @ weights
                yield pd.DataFrame({"sim": np.arange(n) + b * block, "ret": np.prod(1 + daily, axis=1) - 1})

    return spark.range(-(-simulations // block)).mapInPandas(run, "sim long, ret double")


def value_at_risk(simulated: DataFrame, level: float = 0.01) -> DataFrame:
    return simulated.agg(F.percentile("ret", F.lit(level)).alias("var"), F.count("*").alias("simulations"))


def idiosyncratic_ranking(eps: DataFrame, n: int = 5, annualization: int = 252) -> DataFrame:
    """Ticker, idio_vol of the n most and the n least volatile residuals, each side by a bounded sort."""
    vol = eps.groupBy("Ticker").agg((F.stddev_samp("eps") * annualization**0.5).alias("idio_vol")).where("idio_vol is not null")
    top = vol.orderBy(F.desc("idio_vol"), "Ticker").limit(n).withColumn("side", F.lit("top"))
    return top.union(vol.orderBy("idio_vol", "Ticker").limit(n).withColumn("side", F.lit("bottom")))


def turnover_cost(before: DataFrame, after: DataFrame, rate: float = 0.0023, periods: int = 252) -> DataFrame:
    """turnover (half the sum of absolute changes of weights), cost and annual_cost."""
    both = before.select("Ticker", F.col("weight").alias("w0")).join(after.select("Ticker", F.col("weight").alias("w1")), "Ticker", "full")
    moved = both.agg((F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("turnover"))
    return moved.select("turnover", (F.col("turnover") * rate).alias("cost"), (F.col("turnover") * rate * periods).alias("annual_cost"))


def compounded(returns: DataFrame, value: str, order: str = "Date", by: Sequence[str] = ()) -> DataFrame:
    """returns with `wealth`, the running product of 1 + value; missing values count as no change.

    Size, sign and zeros of the product run apart, so that a total loss (-1) leaves 0 for good, and a value below -1 turns
    the sign."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = 1 + F.col(value)
    size = F.exp(F.coalesce(F.sum(F.ln(F.when(growth != 0, F.abs(growth)))).over(w), F.lit(0.0)))
    turns, losses = F.count_if(growth < 0).over(w), F.count_if(growth == 0).over(w)
    return returns.withColumn("wealth", F.when(losses > 0, 0.0).when(turns % 2 == 1, -size).otherwise(size))


def drawdowns(returns: DataFrame, value: str, order: str = "Date", by: Sequence[str] = ()) -> DataFrame:
    """compounded returns with `drawdown`, the wealth over its highest so far, less 1."""
    wealth = compounded(returns, value, order, by)
    peak = F.max("wealth").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return wealth.withColumn("drawdown", safe_div(F.col("wealth"), peak) - 1)


def tear_sheet(returns: DataFrame, value: str = "ret", *, periods: int = 252, cost: float = 0.0, costs_a_year: int = 12) -> DataFrame:
    """One row: annualized return, volatility, Sharpe ratio, largest drawdown, return net of costs. returns is one short series."""
    s = drawdowns(returns, value).agg((F.avg(value) * periods).alias("annual_return"), (F.stddev_samp(value) * periods**0.5).alias("annual_volatility"), F.min("drawdown").alias("max_drawdown"))
    return s.select("annual_return", "annual_volatility", safe_div(F.col("annual_return"), F.col("annual_volatility")).alias("sharpe"), "max_drawdown", (F.col("annual_return") - cost * costs_a_year).alias("net_return"))


def next_day_return(panel: DataFrame, price: str = "px_last") -> DataFrame:
    return panel.select("Date", "Ticker", (safe_div(F.lead(price).over(by_ticker()), F.col(price)) - 1).alias("r"))


def busy_dates(df: DataFrame, least: int = 50, subset: Sequence[str] | None = None) -> DataFrame:
    """Complete rows of the dates that have at least `least` of them."""
    full = df.dropna("any", subset=list(subset) if subset else None)
    return full.join(full.groupBy("Date").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("Date"), "Date", "left_semi")


def held_weights(weights: DataFrame, least: float) -> DataFrame:
    """The positions above `least`."""
    return weights.where(F.col("weight") > least)


def renormalized(weights: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker, weight of the positions among tickers, made to sum to 1; NULL where they sum to 0."""
    kept = weights.join(tickers.select("Ticker").distinct(), "Ticker", "left_semi")
    return kept.select("Ticker", "weight").join(F.broadcast(kept.agg(F.sum("weight").alias("total")))).select("Ticker", safe_div(F.col("weight"), F.col("total")).alias("weight"))


def reported(df: DataFrame, value: str, rows: int = 60) -> DataFrame:
    """df with `value` as it was so many of the ticker's rows before: a stand-in for the time that reports take to appear."""
    return df.withColumn(value, F.lag(value, rows).over(by_ticker()))
