"""Joins that keep the driving side's key grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, *, by: str = "Ticker", on: str = "Date", columns: Sequence[str] | None = None) -> DataFrame:
    """left with `columns` of the latest row of right at or before its own date; one shuffle by key, one sort.

    The matched row counts as a whole: a missing value in it stays missing. Rows of left before any of right get NULLs.
    """
    columns = [c for c in right.columns if c not in (by, on)] if columns is None else list(columns)
    own = [c for c in left.columns if c not in (by, on)]
    a = left.select(by, on, F.struct(*own).alias("l"), F.lit(None).cast(right.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("r"), F.lit(1).alias("side"))
    b = right.select(by, on, F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.struct(*columns).alias("r"), F.lit(0).alias("side"))
    w = Window.partitionBy(by).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(w))
    return both.where("side = 1").select(on, by, *[F.col("l")[c].alias(c) for c in own], *[F.col("r")[c].alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("Date", "Ticker")) -> DataFrame:
    """keys that come up more than once, and how often."""
    return df.groupBy(*keys).count().where("count > 1")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("Date", "Ticker")) -> bool:
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def unique_dimension(facts: DataFrame, dimension: DataFrame, key: str = "Ticker") -> DataFrame:
    """Left many-to-one join; ValueError where the dimension repeats a key."""
    if not duplicate_keys(dimension, [key]).isEmpty():
        raise ValueError(f"the dimension has duplicate values of {key}")
    return facts.join(dimension, key, "left")
