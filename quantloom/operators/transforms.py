"""Cross-sectional transforms: each date on its own.

Statistics of a date are aggregates with map-side combining: they are worked out at once, stored, counted, and sent to
the panel's rows where they are few, so that the panel itself is shuffled by date only if its groups are nearly as many
as its rows. A step reads its input once for each kind of statistics and once for its result: callers with a costly
input store it first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import KEYS, clip, safe_div, without_nan
from ..sources.scratch import join_measured, stored
from .joins import duplicate_keys
from .tails import exact_quantiles


def factor_columns(x: DataFrame, unique: bool = False) -> list[str]:
    """The numeric exposures beside the keys; ValueError where the contract is broken. unique: also look, in a job of its
    own, for keys that come up twice."""
    if not set(KEYS) <= set(x.columns):
        raise ValueError("exposures need the key columns Date and Ticker")
    if not isinstance(x.schema["Date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("the column Date must hold dates")
    names = [c for c in x.columns if c not in KEYS]
    if not names:
        raise ValueError("exposures need at least one factor column")
    wrong = [c for c in names if not isinstance(x.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"exposures must be numeric: {wrong}")
    if unique and not duplicate_keys(x).isEmpty():
        raise ValueError("exposures hold a (Date, Ticker) twice")
    return names


def _number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number")
    return float(value)


def with_statistics(x: DataFrame, by: Sequence[str], statistics: Sequence[Column]) -> DataFrame:
    """x with aggregates of its groups; groups whose key is missing get none."""
    return join_measured(x, x.groupBy(*by).agg(*statistics), by)


def winsorize(x: DataFrame, *, lower_quantile: float = 0.01, upper_quantile: float = 0.99) -> DataFrame:
    """Each factor clipped to interpolated quantiles of its date; missing values stay so."""
    low, high = _number(lower_quantile, "lower_quantile"), _number(upper_quantile, "upper_quantile")
    if not 0 <= low < high <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
    names = factor_columns(x)
    x = without_nan(x)
    q = F.array(F.lit(low), F.lit(high))
    held = with_statistics(x, ["Date"], [F.percentile(c, q).alias(f"__q_{c}") for c in names])
    return held.select(*KEYS, *[clip(F.col(c), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]).alias(c) for c in names])


def winsorize_pooled(df: DataFrame, quantile: float) -> DataFrame:
    """All rows pooled: each double column clipped to its [q, 1 - q] quantiles, found by selection: no task holds the values."""
    if not 0 <= _number(quantile, "quantile") < 0.5:
        raise ValueError("quantile must satisfy 0 <= quantile < 0.5")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not names:
        return df
    df = without_nan(df)
    bounds = exact_quantiles(df, names, [float(quantile), 1.0 - quantile])
    return df.withColumns({c: clip(F.col(c), F.lit(low), F.lit(high)) for c, (low, high) in bounds.items() if low is not None})


def zscore(x: DataFrame, *, ddof: int = 0, least: int = 1) -> DataFrame:
    """(x - mean) / deviation of its date; NULL for the whole date where there is no dispersion or fewer than `least` values."""
    if isinstance(ddof, bool) or not isinstance(ddof, int):
        raise TypeError("ddof must be an integer")
    if ddof < 0:
        raise ValueError("ddof must not be negative")
    names = factor_columns(x)
    x = without_nan(x)
    wanted = [s for c in names for s in (F.avg(c).alias(f"__m_{c}"), F.var_pop(c).alias(f"__v_{c}"), F.count(c).alias(f"__n_{c}"), (F.min(c) < F.max(c)).alias(f"__d_{c}"))]
    held = with_statistics(x, ["Date"], wanted)

    def scaled(c: str) -> Column:
        n = F.col(f"__n_{c}")
        deviation = F.sqrt(F.when(n > ddof, F.col(f"__v_{c}") * n / (n - ddof)))
        return F.when(F.col(f"__d_{c}") & (n >= least), safe_div(F.col(c) - F.col(f"__m_{c}"), deviation))

    return held.select(*KEYS, *[scaled(c).alias(c) for c in names])


def neutralize(x: DataFrame, panel: DataFrame, *, industry_column: str = "gics_sector", market_cap_column: str = "market_cap", neutralize_industry: bool = True, neutralize_size: bool = True) -> DataFrame:
    """Residuals of each date's regression on an intercept, industries and ln(market cap).

    By the Frisch-Waugh theorem no matrix is needed: factor and size are demeaned within industries over the factor's
    valid rows, and the slope is a ratio of sums. Rows without a regressor are NULL; so is a date with no degree of freedom.
    """
    names = factor_columns(x)
    if not (neutralize_industry or neutralize_size):
        return x
    needed = [industry_column] * neutralize_industry + [market_cap_column] * neutralize_size
    if missing := [c for c in needed if c not in panel.columns]:
        raise ValueError(f"panel is missing neutralization columns: {missing}")
    x, panel = without_nan(x), without_nan(panel)
    group = F.col(industry_column) if neutralize_industry else F.lit("all")
    cap = F.ln(F.when(F.col(market_cap_column) > 0, F.col(market_cap_column))) if neutralize_size else F.lit(0.0)
    held = x.join(panel.select(*KEYS, group.alias("__g"), cap.alias("__l")), list(KEYS), "left")
    valid = {c: F.col("__g").isNotNull() & F.col("__l").isNotNull() & F.col(c).isNotNull() for c in names}
    y = {c: F.when(valid[c], F.col(c)) for c in names}
    size = {c: F.when(valid[c], F.col("__l")) for c in names}
    groups = stored(held.groupBy("Date", "__g").agg(*[s for c in names for s in (F.avg(y[c]).alias(f"__y_{c}"), F.avg(size[c]).alias(f"__s_{c}"))]), "groups")
    held = join_measured(held, groups, ["Date", "__g"])
    yd = {c: y[c] - F.col(f"__y_{c}") for c in names}
    sd = {c: size[c] - F.col(f"__s_{c}") for c in names}
    # the number of groups with valid rows comes from the table of groups: one that has none has no mean
    counted = groups.groupBy("Date").agg(*[F.count(f"__y_{c}").alias(f"__k_{c}") for c in names])
    sums = held.groupBy("Date").agg(*[s for c in names for s in (F.sum(yd[c] * sd[c]).alias(f"__ys_{c}"), F.sum(sd[c] * sd[c]).alias(f"__ss_{c}"), F.sum(size[c] * size[c]).alias(f"__ll_{c}"), F.count(y[c]).alias(f"__n_{c}"))])
    held = join_measured(held, sums.join(counted, "Date", "left"), ["Date"])

    def residual(c: str) -> Column:
        sloped = F.col(f"__ss_{c}") > 1e-12 * F.col(f"__ll_{c}")
        slope = F.when(sloped, safe_div(F.col(f"__ys_{c}"), F.col(f"__ss_{c}"))).otherwise(0.0)
        return F.when(F.col(f"__n_{c}") > F.col(f"__k_{c}") + sloped.cast("int"), yd[c] - slope * sd[c])

    return held.select(*KEYS, *[residual(c).alias(c) for c in names])


def orthogonalize(x: DataFrame, *, correlation_threshold: float = 0.70) -> DataFrame:
    """Factor by factor, in column order: residual on the earlier ones (as already processed) whose correlation with it on
    that date exceeds the threshold. What is regressed on what depends on the data of each date, and on the step before;
    a date's cross-section, one row for each instrument, is one group.
    """
    threshold = _number(correlation_threshold, "correlation_threshold")
    if not 0 <= threshold <= 1:
        raise ValueError("correlation_threshold must be between 0 and 1")
    names = factor_columns(x)
    x = without_nan(x.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in names]))

    def one_date(pdf):
        import numpy as np

        a = pdf[names].to_numpy(float, copy=True)
        for k in range(1, len(names)):
            y, chosen = a[:, k], []
            for j in range(k):
                both = np.isfinite(y) & np.isfinite(a[:, j])
                if both.sum() < 2:
                    continue
                u, v = y[both] - y[both].mean(), a[both, j] - a[both, j].mean()
                size = np.sqrt((u @ u) * (v @ v))
                if size > 0 and abs(u @ v) / size > threshold:
                    chosen.append(j)
            if not chosen:
                continue
            valid = np.isfinite(y) & np.isfinite(a[:, chosen]).all(axis=1)
            design = np.column_stack([np.ones(valid.sum()), a[valid][:, chosen]])
            left = np.full(len(y), np.nan)
            if valid.any():
                beta, _, rank, _ = np.linalg.lstsq(design, y[valid], rcond=None)
                if valid.sum() > rank:
                    left[valid] = y[valid] - design @ beta
            a[:, k] = left
        out = pdf[list(KEYS)].copy()
        for k, c in enumerate(names):
            out[c] = a[:, k]
        return out

    done = x.groupBy("Date").applyInPandas(one_date, x.schema)
    return done.select(*KEYS, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
