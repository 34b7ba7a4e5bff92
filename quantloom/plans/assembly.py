"""The panel from its tables: prices give the rows, everything else is joined to them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import KEYS, without_nan
from ..operators.joins import asof_backward, duplicate_keys
from ..sources import workbook
from ..sources.scratch import stored
from ..sources.tables import CONTRACT, contract_panel, keyed_mean, load_parquet, pivot_descriptors

DAILY = ("market_cap", "pb", "earn_yld", "volume", "beta")
QUARTERLY = ("growth_sales", "growth_eps", "leverage")
INDUSTRY = ("gics_sector", "gics_industry_group", "gics_sub_industry")


def _checked(name: str, df: DataFrame, keys, columns) -> DataFrame:
    if missing := sorted({*keys, *columns} - set(df.columns)):
        raise ValueError(f"{name} lacks columns: {missing}")
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{name} holds a key twice")
    return without_nan(df.select(*keys, *columns))


def build_panel(prices: DataFrame, daily: DataFrame, quarterly: DataFrame, industries: DataFrame) -> DataFrame:
    """Every price row once, with its day's descriptors, the latest quarterly row at or before it (as a whole), and the
    ticker's industries. ValueError where a table lacks columns or holds a key twice; as all other sides have each key
    once, no join can change the number of rows."""
    p, d = _checked("prices", prices, KEYS, ["px_last"]), _checked("daily descriptors", daily, KEYS, DAILY)
    q, i = _checked("quarterly descriptors", quarterly, KEYS, QUARTERLY), _checked("industries", industries, ["Ticker"], INDUSTRY)
    return contract_panel(asof_backward(p.join(d, list(KEYS), "left"), q).join(i, "Ticker", "left"))


@dataclass(frozen=True)
class FieldSources:
    """Parquet sources under one root: prices (date, ticker, close), returns (date, ticker, tr), daily and quarterly
    descriptors as (date, ticker, field, value), and industries (ticker and three columns)."""

    root: str
    prices: str = "prices.parquet"
    returns: str = "returns.parquet"
    daily: str = "descriptors_ts.parquet"
    quarterly: str = "descriptors_q_daily.parquet"
    industries: str = "industries.parquet"
    daily_fields: Mapping[str, str] = field(default_factory=lambda: dict(workbook.DAILY))
    quarterly_fields: Mapping[str, str] = field(default_factory=lambda: {**workbook.GROWTH, **workbook.LEVERAGE})

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return load_parquet(spark, f"{self.root.rstrip('/')}/{getattr(self, name)}")


def panel_from_fields(prices: DataFrame, daily: DataFrame, quarterly: DataFrame, industries: DataFrame, *, daily_fields: Mapping[str, str], quarterly_fields: Mapping[str, str]) -> DataFrame:
    """The panel from entity-attribute-value tables whose quarterly fields are already by day: means of repeated prices and
    values, equal-key joins to the price rows, contract columns that no table has as NULL."""
    p = keyed_mean(without_nan(prices), "close", name="px_last")
    for long, fields in ((daily, daily_fields), (quarterly, quarterly_fields)):
        p = p.join(pivot_descriptors(without_nan(long), fields), list(KEYS), "left")
    if not duplicate_keys(industries, ["ticker"]).isEmpty():
        raise ValueError("industries hold a ticker twice")
    i = industries.select(F.col("ticker").alias("Ticker"), *[F.col(k).alias(n) for k, n in workbook.INDUSTRIES.items()])
    return contract_panel(p.join(i, "Ticker", "left"))


def load_field_panel(spark: SparkSession, sources: FieldSources) -> DataFrame:
    return panel_from_fields(*[sources.table(spark, n) for n in ("prices", "daily", "quarterly", "industries")], daily_fields=sources.daily_fields, quarterly_fields=sources.quarterly_fields)


def load_total_returns(spark: SparkSession, sources: FieldSources) -> DataFrame:
    """Date, Ticker, tr: the total-return index as it stands, means of repeated rows."""
    return keyed_mean(sources.table(spark, "returns"), "tr")


def workbook_panel(cells: DataFrame, epoch: str = workbook.EPOCHS[False]) -> DataFrame:
    return build_panel(**workbook.panel_tables(cells, epoch))


def load_workbook_panel(spark: SparkSession, path) -> DataFrame:
    """The panel of a market workbook; its quarterly dates are those of the periods, not of publication."""
    cells, epoch = workbook.read_workbook(spark, path)
    return workbook_panel(stored(cells, "cells"), epoch)


assert {"px_last", *DAILY, *QUARTERLY, *INDUSTRY} == set(CONTRACT)
