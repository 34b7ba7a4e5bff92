"""Exponentially weighted moments as aggregates, not as loops over dates.

The recursion  S_t = decay * S_(t-1) + (1 - decay) * v_t  from S = 0 is a sum of v weighted by the distance in rows. Rows are
dealt to blocks by their place in the series; a block's state is its sum as of its last place. States are added up after
each is carried on to a common place by a power of decay: that is associative, so that blocks (or any parts of the rows)
may be summed up anywhere and in any order, and no power is larger than a block is long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import null_nan

#: Places of a block: decay to this power must not vanish.
BLOCK = 64


def _checked(decay: float) -> float:
    if not 0 < decay < 1:
        raise ValueError("decay must be between 0 and 1")
    return float(decay)


def ewma_states(placed: DataFrame, values: Sequence[Column], decay: float, by: Sequence[str] = (), place: str = "place") -> DataFrame:
    """by, block and sums: of each block the weighted sums of values as of the block's last place. `place` numbers a series'
    rows from 0; missing values count as 0, their places do count."""
    decay = _checked(decay)
    block = F.floor(F.col(place) / BLOCK)
    weight = (1 - decay) * F.pow(F.lit(decay), (block + 1) * BLOCK - 1 - F.col(place))
    return placed.groupBy(*by, block.alias("block")).agg(F.array(*[F.coalesce(F.sum(weight * v), F.lit(0.0)) for v in values]).alias("sums"))


def merge_states(states: DataFrame, last: int | Column, size: int, decay: float, by: Sequence[str] = ()) -> DataFrame:
    """by and sums as of the place `last`: states of whatever parts, in whatever order."""
    decay = _checked(decay)
    weight = F.pow(F.lit(decay), (F.lit(last) if isinstance(last, int) else last) - ((F.col("block") + 1) * BLOCK - 1))
    return states.groupBy(*by).agg(F.array(*[F.sum(weight * F.col("sums")[i]) for i in range(size)]).alias("sums"))


def ewma_covariance(returns: DataFrame, names: Sequence[str], decay: float = 0.94, *, normalize: bool = False) -> DataFrame:
    """factor_i, factor_j, cov: the recursion over products of returns (Date and names; a short series, complete rows only), in
    order of dates, as of the last one. normalize: over the sum of weights, 1 - decay ** n, that a short series lacks."""
    names = list(names)
    full = returns.select("Date", *[null_nan(F.col(c).cast("double")).alias(c) for c in names]).dropna("any", subset=["Date", *names])
    placed = full.withColumn("place", F.row_number().over(Window.orderBy("Date")) - 1)  # a row a date
    n = full.count()
    if not n:
        raise ValueError("there are no complete returns")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    merged = merge_states(ewma_states(placed, [F.col(a) * F.col(b) for a, b in pairs], decay), n - 1, len(pairs), decay)
    over = 1 - decay**n if normalize else 1.0
    cells = F.array(*[F.struct(F.lit(p).alias("factor_i"), F.lit(q).alias("factor_j"), (F.col("sums")[i] / over).alias("cov")) for i, (a, b) in enumerate(pairs) for p, q in dict.fromkeys(((a, b), (b, a)))])
    return merged.select(F.inline(cells))


def exponential_mean(df: DataFrame, value: Column, decay: float, *, by: Sequence[str] = ("Ticker",), order: str = "Date", name: str = "ewma") -> DataFrame:
    """df with the recursion over value (missing: 0) at each of its rows, in order of each series; by names the series.

    Within a block by a running sum, before it by the states of earlier blocks: a series of n rows has n / BLOCK of these.
    """
    decay = _checked(decay)
    places = Window.partitionBy(*by).orderBy(order)
    held = df.withColumn("__place", F.row_number().over(places) - 1).withColumns({"__block": F.floor(F.col("__place") / BLOCK), "__v": F.coalesce(null_nan(value.cast("double")), F.lit(0.0))})
    at = F.col("__place") - F.col("__block") * BLOCK
    inside = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__inside", F.sum(F.col("__v") * F.pow(F.lit(decay), -at)).over(inside) * F.pow(F.lit(decay), at))
    # one row of each block stands for it: its last one; those before this row's block are folded, the oldest first
    ends = F.when((F.col("__place") + 1) % BLOCK == 0, F.col("__inside"))
    before = Window.partitionBy(*by).orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(ends).over(before)
    carried = F.aggregate(earlier, F.lit(0.0), lambda s, x: s * decay**BLOCK + x)
    out = held.withColumn(name, (1 - decay) * (F.col("__inside") + carried * F.pow(F.lit(decay), at + 1)))
    return out.drop("__place", "__block", "__v", "__inside")


def ewma_volatility(returns: DataFrame, decay: float = 0.94, *, value: str = "r", annualization: int = 252) -> DataFrame:
    """Date, Ticker, vol: the root of each ticker's weighted squares, annualized, over its rows so far; NULL before its first return."""
    held = returns.select("Date", "Ticker", null_nan(F.col(value).cast("double")).alias("v")).where("v is not null")
    out = exponential_mean(held, F.col("v") * F.col("v"), decay, name="variance")
    return out.select("Date", "Ticker", F.sqrt(F.col("variance") * annualization).alias("vol"))
