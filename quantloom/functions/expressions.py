"""Column expressions that are safe under ANSI mode. Missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEYS = ("Date", "Ticker")


def null_nan(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame) -> DataFrame:
    """df with NULL for each NaN: every source and every operator that takes a user's doubles begins with this."""
    names = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.select(*[null_nan(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]) if names else df


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or missing."""
    return F.try_divide(a, b)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; a missing x stays missing (least and greatest alone skip NULLs)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def paired_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; NULL where either has no dispersion."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    varied = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(varied, F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py)))


def quantile_bucket(rank: Column, n: Column, q: int) -> Column:
    """0-based bucket of a 1-based rank among n: intervals (edge, edge] between interpolated quantiles of 1..n.

    The first edge belongs to the first bucket. Integer arithmetic, exact in the reals.
    """
    up = F.floor(((rank - 1) * q + n - 2) / F.greatest(n - 1, F.lit(1)))
    return (F.greatest(up, F.lit(1)) - 1).cast("int")


def by_ticker() -> WindowSpec:
    return Window.partitionBy("Ticker").orderBy("Date")


def full_window(aggregate, c: Column, n: int, least: int | None = None) -> Column:
    """aggregate of c over this row and the n - 1 before it of the same ticker; NULL with fewer than `least` (n) values."""
    w = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(w) >= (n if least is None else least), aggregate(c).over(w))
