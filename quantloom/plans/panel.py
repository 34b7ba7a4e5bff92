"""The stand-in panel: (month, supplier) sums of the order lines, with quarterly descriptors by as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import by_ticker, safe_div
from ..operators.joins import asof_backward
from ..sources.tables import contract_panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by (month, supplier) first, on keys of the order lines alone; names and regions join the few rows left."""
    price, quantity, discount = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("Date"), "l_suppkey").agg(F.sum(price).alias("p"), F.sum(quantity).alias("q"), F.sum(price * (1 - discount)).alias("net"), F.avg(discount).alias("d"), F.avg("l_tax").alias("t"))
    dim = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")
    held = sums.join(dim, F.expr("l_suppkey = s_suppkey"))
    return held.select("Date", F.col("s_name").alias("Ticker"), safe_div(F.col("p"), F.col("q")).alias("px_last"), F.col("p").alias("market_cap"), safe_div(F.col("p"), F.col("net")).alias("pb"), (F.col("d") - 0.05).alias("earn_yld"), (F.col("t") / 0.04).alias("beta"), F.col("q").alias("volume"), F.col("r_name").alias("gics_sector"), F.col("n_name").alias("gics_industry_group"), F.col("s_name").alias("gics_sub_industry"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth and leverage by quarter, effective one month after its end."""
    price = F.col("l_extendedprice")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 4).alias("Date"), "l_suppkey").agg(F.sum(price).alias("sales"), F.sum(price * (1 - F.col("l_discount"))).alias("net"), F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0)).alias("returned"))
    held = sums.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("Ticker")), F.expr("l_suppkey = s_suppkey"))
    growth = lambda c: safe_div(F.col(c), F.lag(c).over(by_ticker())) - 1
    return held.select("Date", "Ticker", growth("sales").alias("growth_sales"), growth("net").alias("growth_eps"), safe_div(F.col("returned"), F.col("sales") - F.col("returned")).alias("leverage"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_panel(asof_backward(monthly(spark, sf_dir), quarterly(spark, sf_dir)))
