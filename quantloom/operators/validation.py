"""Factor validation: information coefficients, their significance, quantile portfolios, correlations, admission."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import KEYS, by_ticker, null_nan, paired_corr, quantile_bucket, safe_div, without_nan
from ..functions.shipping import ship
from ..sources.scratch import stored
from .transforms import factor_columns


@dataclass(frozen=True)
class ValidationConfig:
    horizon: int = 21
    quantiles: int = 5
    newey_west_lags: int = 5
    min_cross_section: int = 20
    min_dates: int = 60
    annualization: int = 252
    accepted_ic: float = 0.03
    accepted_t: float = 2.0
    accepted_coverage: float = 0.70
    candidate_ic: float = 0.01
    candidate_coverage: float = 0.50

    def __post_init__(self):
        whole = {"horizon": 1, "quantiles": 2, "newey_west_lags": 0, "min_cross_section": 2, "min_dates": 1, "annualization": 1}
        for name, least in whole.items():
            v = getattr(self, name)
            if type(v) is not int:
                raise TypeError(f"{name} must be an integer")
            if v < least:
                raise ValueError(f"{name} must be {least} or more")
        most = {"accepted_ic": math.inf, "accepted_t": math.inf, "candidate_ic": math.inf, "accepted_coverage": 1, "candidate_coverage": 1}
        for name, top in most.items():
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not 0 <= v <= top:
                raise ValueError(f"{name} must be a number, 0 or more" + (" and 1 or less" if top == 1 else ""))


def check_alignment(x: DataFrame, label: DataFrame, value: str = "forward_return") -> None:
    """ValueError unless x has rows and factors, and label has numbers for exactly its keys, each key once on both sides:
    labels that fit other rows would only show as a lower coverage."""
    factor_columns(x)
    if not isinstance(label.schema[value].dataType, T.NumericType):
        raise ValueError("labels must be numbers")
    if x.isEmpty():
        raise ValueError("there are no exposures")
    sides = x.select(*KEYS, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(label.select(*KEYS, F.lit(0).alias("x"), F.lit(1).alias("y")))
    odd = sides.groupBy(*KEYS).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x <> 1 or y <> 1").first()
    if odd is not None:
        raise ValueError(f"exposures and labels must have the same keys, each once; not so for {odd['Date']}, {odd['Ticker']}")


def forward_return(panel: DataFrame, horizon: int = 21, price: str = "px_last") -> DataFrame:
    """Date, Ticker, forward_return = p(t + horizon) / p(t) - 1 by position."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    p = panel.select(*KEYS, null_nan(F.col(price)).alias("p"))
    return p.select(*KEYS, (safe_div(F.lead("p", horizon).over(by_ticker()), F.col("p")) - 1).alias("forward_return"))


def labelled(x: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (Date, Ticker, factor, x, y) of every exposure with its label."""
    names = factor_columns(x)
    held = without_nan(x).join(label.select(*KEYS, null_nan(F.col("forward_return")).alias("y")), list(KEYS), "left")
    return held.unpivot([*KEYS, "y"], names, "factor", "x")


def daily_ic(long: DataFrame, min_cross_section: int = 20) -> DataFrame:
    """Date, factor, ic, rank_ic; NULL on dates with too few pairs or no dispersion."""
    own = Window.partitionBy("Date", "factor")
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.when(paired, F.col("x")), F.when(paired, F.col("y"))
    # all ranks by one partitioning: a tie's average rank is the mean of its first and its last one
    ranked = long.select("Date", "factor", px.alias("x"), py.alias("y"), F.count(F.when(paired, 1)).over(own).alias("n"))
    average = lambda c: F.when(F.col(c).isNotNull(), (F.rank().over(own.orderBy(F.col(c).asc_nulls_last())) + F.col("n") + 1 - F.rank().over(own.orderBy(F.col(c).desc_nulls_last()))) / 2)
    ranked = ranked.select("Date", "factor", "x", "y", average("x").alias("rx"), average("y").alias("ry"))
    daily = ranked.groupBy("Date", "factor").agg(F.count("x").alias("n"), paired_corr(F.col("x"), F.col("y")).alias("ic"), paired_corr(F.col("rx"), F.col("ry")).alias("rank_ic"))
    enough = F.col("n") >= min_cross_section
    return daily.select("Date", "factor", F.when(enough, F.col("ic")).alias("ic"), F.when(enough, F.col("rank_ic")).alias("rank_ic"))


def newey_west(series: DataFrame, value: str, lags: int, by: str = "factor", order: str = "Date") -> DataFrame:
    """by, nw_t: the mean over the root of its Bartlett-weighted long-run variance; missing values close up.

    At most lags of the series' length less one are used. NULL for fewer than two values or a variance of 0 or less.
    """
    w = Window.partitionBy(by).orderBy(order)
    own = Window.partitionBy(by)
    e = series.where(F.col(value).isNotNull()).select(by, order, F.col(value).alias("v"), (F.col(value) - F.avg(value).over(own)).alias("e"), F.count("*").over(own).alias("n"))
    e = e.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    sums = e.groupBy(by).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.sum(F.col("e") ** 2).alias("g0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, lags + 1)])
    most = F.least(F.lit(lags), F.col("n") - 1)
    total: Column = F.col("g0")
    for k in range(1, lags + 1):
        total = total + F.when(most >= k, 2 * (1 - F.lit(float(k)) / (most + 1)) * F.col(f"g{k}")).otherwise(0.0)
    variance = total / F.col("n")
    return sums.select(by, F.when((F.col("n") >= 2) & (variance > 0), F.col("m") / F.sqrt(variance / F.col("n"))).alias("nw_t"))


def quantile_returns(long: DataFrame, quantiles: int = 5, min_cross_section: int = 20) -> DataFrame:
    """Date, factor, q1 .. qN (mean labels of buckets by exposure, ties by ticker) and spread; dates that fail the guards are absent."""
    both = long.where("x is not null and y is not null")
    own = Window.partitionBy("Date", "factor")
    ranked = both.select("Date", "factor", "y", F.row_number().over(own.orderBy("x", "Ticker")).alias("r"), F.count("*").over(own).alias("n"), (F.min("x").over(own) < F.max("x").over(own)).alias("varied"))
    placed = ranked.where((F.col("n") >= max(min_cross_section, quantiles)) & F.col("varied")).withColumn("b", quantile_bucket(F.col("r"), F.col("n"), quantiles))
    out = placed.groupBy("Date", "factor").agg(*[F.avg(F.when(F.col("b") == k, F.col("y"))).alias(f"q{k + 1}") for k in range(quantiles)])
    return out.withColumn("spread", F.col(f"q{quantiles}") - F.col("q1"))


def factor_correlations(x: DataFrame) -> DataFrame:
    """factor_i, factor_j, correlation: daily pairwise correlations, averaged over the dates that have one."""
    names = factor_columns(x)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    daily = x.groupBy("Date").agg(*[paired_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    means = daily.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(pairs))])
    rows = F.array(*[F.struct(F.lit(p).alias("factor_i"), F.lit(q).alias("factor_j"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs) for p, q in dict.fromkeys(((a, b), (b, a)))])
    return means.select(F.inline(rows))


def admission(c: ValidationConfig) -> Column:
    """accepted, candidate or rejected; what is missing, or NaN, meets no threshold."""
    ic, t, coverage = F.abs(null_nan(F.col("mean_rank_ic"))), F.abs(null_nan(F.col("nw_t"))), null_nan(F.col("coverage"))
    accepted = (ic >= c.accepted_ic) & (t >= c.accepted_t) & (coverage >= c.accepted_coverage) & (F.col("n_dates") >= c.min_dates)
    candidate = (ic >= c.candidate_ic) & (coverage >= c.candidate_coverage)
    return F.when(accepted, "accepted").when(candidate, "candidate").otherwise("rejected")


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values have the mean of theirs."""
    order = np.argsort(v, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], v[order][1:] != v[order][:-1])))
    size = np.diff(np.append(first, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or x.min() == x.max() or y.min() == y.max():
        return np.nan
    u, v = x - x.mean(), y - y.mean()
    size = np.sqrt((u @ u) * (v @ v))
    return u @ v / size if size > 0 else np.nan


def cross_section(a: np.ndarray, y: np.ndarray, ticker: np.ndarray, quantiles: int, min_cross_section: int) -> list[tuple]:
    """For each column of a (rows are one date's instruments): pairs with a label, labels, IC, rank IC, mean labels of
    quantile buckets (or None), and correlations with all columns. Missing is NaN."""
    out, labels, k = [], int(np.isfinite(y).sum()), a.shape[1]
    finite, related = np.isfinite(a), np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i, k):
            both = finite[:, i] & finite[:, j]
            related[i, j] = related[j, i] = _correlation(a[both, i], a[both, j])
    by_name = np.argsort(ticker, kind="stable")
    for i in range(k):
        paired = by_name[(finite[:, i] & np.isfinite(y))[by_name]]
        x, z, n = a[paired, i], y[paired], len(paired)
        ic = rank_ic = np.nan
        if n >= min_cross_section:
            ic, rank_ic = _correlation(x, z), _correlation(average_ranks(x), average_ranks(z))
        means = None
        if n >= max(min_cross_section, quantiles) and x.min() < x.max():
            r = np.empty(n, np.int64)
            r[np.argsort(x, kind="stable")] = np.arange(1, n + 1)  # ties by ticker
            bucket = np.maximum(((r - 1) * quantiles + n - 2) // max(n - 1, 1), 1) - 1
            means = [float(z[bucket == b].mean()) if (bucket == b).any() else None for b in range(quantiles)]
        out.append((n, labels, ic, rank_ic, means, related[i].tolist()))
    return out


def daily_statistics(x: DataFrame, label: DataFrame, quantiles: int = 5, min_cross_section: int = 20) -> DataFrame:
    """Date, factor, paired, labels, ic, rank_ic, means (of quantile buckets; NULL where a guard fails) and related
    (correlations with all factors in order): all that validation needs of a date, from one shuffle of the wide rows and
    one look at each cross-section (a group is a date: a row for each instrument)."""
    import pandas as pd

    names = factor_columns(x)
    ship(x.sparkSession)
    wide = without_nan(x).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in names])
    held = wide.join(label.select(*KEYS, null_nan(F.col("forward_return")).cast("double").alias("__y")), list(KEYS), "left")

    def one_date(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = cross_section(pdf[names].to_numpy(float), pdf["__y"].to_numpy(float), pdf["Ticker"].to_numpy(str), quantiles, min_cross_section)
        return pd.DataFrame([(pdf["Date"].iloc[0], n, *r) for n, r in zip(names, rows, strict=True)], columns=["Date", "factor", "paired", "labels", "ic", "rank_ic", "means", "related"])

    schema = T.StructType([x.schema["Date"], *[T.StructField(n, t) for n, t in (("factor", T.StringType()), ("paired", T.LongType()), ("labels", T.LongType()), ("ic", T.DoubleType()), ("rank_ic", T.DoubleType()), ("means", T.ArrayType(T.DoubleType())), ("related", T.ArrayType(T.DoubleType())))]])
    out = held.groupBy("Date").applyInPandas(one_date, schema)
    return out.withColumns({"ic": null_nan(F.col("ic")), "rank_ic": null_nan(F.col("rank_ic")), "related": F.transform("related", null_nan)})


def validate_factors(x: DataFrame, label: DataFrame, config: ValidationConfig = ValidationConfig()) -> dict[str, DataFrame]:
    """daily (ICs), summary (one row a factor with its admission), quantiles and correlations.

    All four come from daily_statistics, a row for each date and factor, which is stored. check_alignment says beforehand
    whether labels fit."""
    names = factor_columns(x)
    each = stored(daily_statistics(x, label, config.quantiles, config.min_cross_section), "validation")
    daily = each.select("Date", "factor", "ic", "rank_ic")
    quantiles = each.where("means is not null").select("Date", "factor", *[F.col("means")[b].alias(f"q{b + 1}") for b in range(config.quantiles)])
    quantiles = quantiles.withColumn("spread", F.col(f"q{config.quantiles}") - F.col("q1"))
    coverage = F.coalesce(safe_div(F.sum("paired").cast("double"), F.sum("labels").cast("double")), F.lit(0.0))
    stats = each.groupBy("factor").agg(F.count("rank_ic").alias("n_dates"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("sd_rank_ic"), coverage.alias("coverage"), F.avg(F.col("means")[config.quantiles - 1] - F.col("means")[0]).alias("mean_spread"))
    ratio = lambda m, s: F.when(F.col(s) > 0, safe_div(F.col(m), F.col(s)) * config.annualization**0.5)
    summary = stats.join(newey_west(daily, "rank_ic", config.newey_west_lags), "factor", "left")
    summary = summary.select("factor", "n_dates", "mean_ic", "mean_rank_ic", ratio("mean_ic", "sd_ic").alias("icir"), ratio("mean_rank_ic", "sd_rank_ic").alias("rank_icir"), "nw_t", "coverage", "mean_spread", admission(config).alias("status"))
    pairs = each.select(F.col("factor").alias("factor_i"), F.posexplode("related").alias("at", "c"))
    correlations = pairs.groupBy("factor_i", F.get(F.array(*map(F.lit, names)), F.col("at")).alias("factor_j")).agg(F.avg("c").alias("correlation"))
    return {"daily": daily, "summary": summary, "quantiles": quantiles, "correlations": correlations}
