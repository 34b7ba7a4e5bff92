"""Raw factor exposures: each factor is an expression over a ticker's rows, in date order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import KEYS, by_ticker, full_window, positive, safe_div, without_nan


@dataclass(frozen=True)
class Factor:
    """name, the columns it needs, helper columns that are worked out first, and the exposure."""

    name: str
    required_columns: tuple[str, ...]

    def helpers(self) -> dict[str, Column]:
        return {}

    def expr(self) -> Column:
        return F.col(self.required_columns[0]).cast("double")


@dataclass(frozen=True)
class LogFactor(Factor):
    """sign * ln(x) where x > 0."""

    sign: int = 1

    def expr(self) -> Column:
        return self.sign * F.ln(positive(F.col(self.required_columns[0])))


@dataclass(frozen=True)
class Momentum(Factor):
    """p(t - skip) / p(t - lookback) - 1 by position among the ticker's rows; a price that isn't positive keeps its place."""

    name: str = "momentum"
    required_columns: tuple[str, ...] = ("px_last",)
    lookback_days: int = 252
    skip_days: int = 21

    def __post_init__(self):
        if not self.lookback_days > self.skip_days >= 0:
            raise ValueError("lookback_days must be greater than skip_days, and skip_days not negative")

    def expr(self) -> Column:
        p = positive(F.col("px_last"))
        return safe_div(F.lag(p, self.skip_days).over(by_ticker()), F.lag(p, self.lookback_days).over(by_ticker())) - 1


@dataclass(frozen=True)
class Volatility(Factor):
    """Population deviation of the last `window_days` simple returns, all of them present, annualized."""

    name: str = "volatility"
    required_columns: tuple[str, ...] = ("px_last",)
    window_days: int = 60
    annualization: int = 252

    def __post_init__(self):
        if self.window_days < 2 or self.annualization <= 0:
            raise ValueError("window_days must be at least 2 and annualization positive")

    def helpers(self) -> dict[str, Column]:
        p = positive(F.col("px_last"))
        return {"__return": safe_div(p, F.lag(p).over(by_ticker())) - 1}

    def expr(self) -> Column:
        return full_window(F.stddev_pop, F.col("__return"), self.window_days) * F.sqrt(F.lit(float(self.annualization)))


@dataclass(frozen=True)
class Liquidity(Factor):
    """ln of the mean of the last `window_days` volumes, all of them positive."""

    name: str = "liquidity"
    required_columns: tuple[str, ...] = ("volume",)
    window_days: int = 60

    def expr(self) -> Column:
        return F.ln(full_window(F.avg, positive(F.col("volume")), self.window_days))


SIZE = LogFactor("size", ("market_cap",))
VALUE = LogFactor("value", ("pb",), -1)
PASSED = {n: Factor(n, (n,)) for n in ("earn_yld", "beta", "growth_sales", "growth_eps", "leverage")}


def standard_factors(momentum: Momentum = Momentum(), volatility: Volatility = Volatility(), liquidity: Liquidity = Liquidity()) -> tuple[Factor, ...]:
    """The ten factors, in registration order."""
    return (SIZE, VALUE, PASSED["earn_yld"], momentum, volatility, PASSED["beta"], liquidity, PASSED["growth_sales"], PASSED["growth_eps"], PASSED["leverage"])


def check_factors(factors: Sequence[Factor], columns: Sequence[str]) -> None:
    """TypeError for what isn't a factor; ValueError for none, blank or repeated names, and missing columns."""
    if not factors:
        raise ValueError("factors must not be empty")
    for f in factors:
        if not isinstance(f, Factor):
            raise TypeError("every factor must be a Factor")
        if not f.name.strip():
            raise ValueError("factor names must not be blank")
    names = [f.name for f in factors]
    if len(set(names)) < len(names):
        raise ValueError("factor names must be unique")
    missing = sorted({c for f in factors for c in f.required_columns} - set(columns) | set(KEYS) - set(columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def compute_raw_exposures(panel: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """Date, Ticker and one column for each factor. All windows share one partitioning and sort order."""
    check_factors(factors, panel.columns)
    panel = without_nan(panel)
    helpers = {k: c for f in factors for k, c in f.helpers().items()}
    return (panel.withColumns(helpers) if helpers else panel).select(*KEYS, *[f.expr().alias(f.name) for f in factors])
