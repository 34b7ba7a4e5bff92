"""What a series of returns paid for its risk: downside, drawdown, tracking and growth ratios of many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import null_nan, positive, safe_div
from ..sources.scratch import join_measured
from .portfolio import drawdowns


def performance_ratios(returns: DataFrame, benchmark: DataFrame | None = None, *, value: str = "r", by: Sequence[str] = ("Ticker",), periods: int = 252, target: float = 0.0, fraction: float = 0.5) -> DataFrame:
    """by and, for each series: n (values), annual_return (geometric), downside (annualized root of the mean squared
    shortfall below target, a return a period), sortino, max_drawdown, calmar, tracking_error and information_ratio (against
    the benchmark's Date and value, on dates that have both), kelly (mean over variance of a period) and held_kelly, the
    fraction of it that is put in, none where it is negative.

    A series has a row a date; it is one window's partition, as long as there are dates. Missing values and rows without a
    date are no part of it; of a benchmark's several values for a date the mean counts. Ratios whose risk is 0 or missing are
    NULL, as is the annual return of a series that ends below 0; after a total loss it is -1. The highest wealth starts with
    the first value. Other columns have no part in it; an empty table gives no rows.
    """
    if type(periods) is not int or periods < 1:
        raise ValueError("periods must be an integer of 1 or more")
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    x = F.col("__r")
    own = returns.select(*by, "Date", null_nan(F.col(value).cast("double")).alias("__r")).where(x.isNotNull() & F.col("Date").isNotNull())
    if benchmark is not None:
        held = benchmark.select("Date", null_nan(F.col(value).cast("double")).alias("__b")).groupBy("Date").agg(F.avg("__b").alias("__b"))
        own = join_measured(own, held, ["Date"])
    else:
        own = own.withColumn("__b", F.lit(None).cast("double"))
    active, short = x - F.col("__b"), F.least(x - target, F.lit(0.0))
    sums = drawdowns(own, "__r", by=by).groupBy(*by).agg(
        F.count("*").alias("n"), F.max_by("wealth", "Date").alias("__end"), F.avg(x).alias("__m"), F.var_samp(x).alias("__v"), (F.sqrt(F.avg(short * short)) * periods**0.5).alias("downside"),
        F.min("drawdown").alias("max_drawdown"), F.avg(active).alias("__a"), F.stddev_samp(active).alias("__te"),
    )
    annual = F.when(F.col("__end") >= 0, F.pow(F.col("__end"), F.lit(float(periods)) / F.col("n")) - 1)
    kelly = safe_div(F.col("__m"), F.col("__v"))
    told = sums.withColumns({"annual_return": annual, "kelly": kelly, "tracking_error": F.col("__te") * periods**0.5})
    return told.select(
        *by, "n", "annual_return", "downside", safe_div((F.col("__m") - target) * periods, F.col("downside")).alias("sortino"), "max_drawdown", safe_div(F.col("annual_return"), -F.col("max_drawdown")).alias("calmar"),
        "tracking_error", safe_div(F.col("__a") * periods, F.col("tracking_error")).alias("information_ratio"), "kelly", F.coalesce(positive(F.col("kelly")) * fraction, F.when(F.col("kelly").isNotNull(), 0.0)).alias("held_kelly"),
    )
