"""The structured risk model: factor returns, factor covariance, specific variance, decomposition, self-check.

What grows with instruments or dates stays in DataFrames (long, never dense); what is of the size of the factor list
(K x K, at most a few hundred numbers) is worked out on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import KEYS, by_ticker, full_window, null_nan, safe_div
from ..functions.shipping import ship
from ..sources.scratch import BROADCAST_NUMBERS, stored


def simple_returns(prices: DataFrame, price: str = "px_last") -> DataFrame:
    """Date, Ticker, r: the change against the ticker's previous row; nothing is filled."""
    p = prices.select(*KEYS, null_nan(F.col(price)).alias("p"))
    return p.select(*KEYS, (safe_div(F.col("p"), F.lag("p").over(by_ticker())) - 1).alias("r"))


def aligned_panel(x: DataFrame, r: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Rows of x with their return, complete in all factors and r."""
    return x.join(r, list(KEYS), "left").dropna("any", subset=[*factors, "r"])


#: Of a date's Gram matrix with a unit diagonal: eigenvalues up to this share of the largest count as 0.
RANK_TOLERANCE = 1e-13


def least_norm(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each (T x K x K, T x K) the least-norm solution of the normal equations.

    Columns are first scaled to a unit diagonal, so that their units have no part in what counts as dependent. Where some
    are dependent, what lies in the null space of the unscaled columns is taken off: the solution is the one of least
    norm in the units given."""
    root = np.sqrt(np.einsum("tii->ti", gram))
    scale = np.where(root > 0, root, 1.0)
    unit = gram / (scale[:, :, None] * scale[:, None, :])
    values, vectors = np.linalg.eigh(unit)
    kept = values > RANK_TOLERANCE * np.maximum(values[:, -1:], 1e-300)
    inverse = np.where(kept, 1 / np.where(kept, values, 1.0), 0.0)
    beta = np.einsum("tik,tk,tjk,tj->ti", vectors, inverse, vectors, b / scale) / scale
    for t in np.flatnonzero(~kept.all(axis=1)):
        null, _ = np.linalg.qr(vectors[t][:, ~kept[t]] / scale[t][:, None])
        beta[t] -= null @ (null.T @ beta[t])
    return beta


def factor_returns(aligned: DataFrame, factors: Sequence[str], *, weights: str | None = None, intercept: bool = False) -> DataFrame:
    """Date and a column for each factor (and `const`): each date's regression of r, NULL where rows are fewer than K + 1.

    One aggregate of sums of products for each date, then the least-norm solution from it; weights multiply the squares,
    negative ones count as 0.
    """
    names = ["const"] * intercept + list(factors)
    column = {n: F.lit(1.0) if n == "const" else F.col(n) for n in names}
    w = F.greatest(F.col(weights), F.lit(0.0)) if weights else F.lit(1.0)
    k = len(names)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = aligned.groupBy("Date").agg(F.count("*").alias("n"), F.array(*[F.sum(w * column[names[i]] * column[names[j]]) for i, j in cells]).alias("g"), F.array(*[F.sum(w * column[c] * F.col("r")) for c in names]).alias("b"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            gram = np.zeros((len(pdf), k, k))
            rows = np.array(pdf["g"].tolist(), float).reshape(len(pdf), len(cells))
            for c, (i, j) in enumerate(cells):
                gram[:, i, j] = gram[:, j, i] = rows[:, c]
            out = pd.DataFrame(least_norm(gram, np.array(pdf["b"].tolist(), float).reshape(len(pdf), k)), columns=names)
            out[(pdf["n"] < k + 1).to_numpy()] = np.nan
            out.insert(0, "Date", pdf["Date"].to_numpy())
            yield out

    ship(aligned.sparkSession)
    schema = T.StructType([aligned.schema["Date"], *[T.StructField(n, T.DoubleType()) for n in names]])
    solved = sums.mapInPandas(solve, schema)
    return solved.select("Date", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def residual_returns(aligned: DataFrame, returns: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Date, Ticker, eps of every aligned row; NULL on dates without factor returns. Never weighted."""
    named = returns.select("Date", *[F.col(n).alias(f"__f_{n}") for n in returns.columns if n != "Date"])
    fitted = sum((F.col(n) * F.col(f"__f_{n}") for n in factors), F.col("__f_const") if "const" in returns.columns else F.lit(0.0))
    return aligned.join(named, "Date", "left").select(*KEYS, (F.col("r") - fitted).alias("eps"))


def factor_covariance(returns: DataFrame, *, shrinkage: str = "ledoit-wolf") -> DataFrame:
    """factor_i, factor_j, cov over the dates that have all factors: sample (n - 1) or Ledoit-Wolf (shrunk to a multiple
    of the identity). Dates that weren't solved are dropped."""
    if shrinkage not in ("ledoit-wolf", "sample"):
        raise ValueError("shrinkage must be 'ledoit-wolf' or 'sample'")
    names = [c for c in returns.columns if c != "Date"]
    full = returns.dropna("any", subset=names)
    full = full.persist()
    means = full.agg(*[F.avg(c).alias(c) for c in names]).first()
    if any(means[c] is None for c in names):
        full.unpersist()
        raise ValueError("there are no complete factor returns")
    x = {c: F.col(c) - F.lit(means[c]) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = full.agg(F.count("*").alias("n"), *[s for i, (a, b) in enumerate(pairs) for s in (F.sum(x[a] * x[b]).alias(f"s{i}"), F.sum(x[a] * x[a] * x[b] * x[b]).alias(f"t{i}"))]).first()
    full.unpersist()
    n, p = row["n"], len(names)
    s, t = np.zeros((p, p)), np.zeros((p, p))
    for i, (a, b) in enumerate(pairs):
        j, k = names.index(a), names.index(b)
        s[j, k] = s[k, j] = row[f"s{i}"] / n
        t[j, k] = t[k, j] = row[f"t{i}"] / n
    if shrinkage == "sample":
        cov = s * n / (n - 1) if n > 1 else np.full_like(s, np.nan)
    else:
        mu, square = np.trace(s) / p, (s**2).sum()
        delta = (square - p * mu**2) / p
        beta = min((t.sum() - square) / (p * n), delta)
        share = beta / delta if beta > 0 and delta > 0 else 0.0
        cov = (1 - share) * s + share * mu * np.eye(p)
    return full.sparkSession.createDataFrame([(a, b, None if np.isnan(v := float(cov[j, k])) else v) for j, a in enumerate(names) for k, b in enumerate(names)], "factor_i string, factor_j string, cov double")


def specific_variance(eps: DataFrame, *, shrinkage: str = "none") -> DataFrame:
    """Ticker, specific_var: sample variance of residuals; the mean over tickers where there is none; 'diagonal' shrinks
    by a fifth to that mean."""
    if shrinkage not in ("none", "diagonal"):
        raise ValueError("shrinkage must be 'none' or 'diagonal'")
    own = eps.groupBy("Ticker").agg(F.var_samp("eps").alias("v"))
    own = own.join(F.broadcast(own.agg(F.avg("v").alias("mean"))))  # one row
    mean = F.col("mean")
    v = F.coalesce("v", mean)
    return own.select("Ticker", (v if shrinkage == "none" else 0.8 * v + 0.2 * mean).alias("specific_var"))


def matrix(covariance: DataFrame, factors: Sequence[str]) -> np.ndarray:
    """The K x K covariance on the driver, in the order of factors."""
    cells = {(r["factor_i"], r["factor_j"]): r["cov"] for r in covariance.collect()}
    return np.array([[cells[a, b] for b in factors] for a in factors], float)


def smallest_eigenvalue(m: np.ndarray) -> float:
    return float(np.linalg.eigvalsh((m + m.T) / 2)[0])


def quadratic(left: Sequence[Column], f: np.ndarray, right: Sequence[Column]) -> Column:
    return sum((left[i] * float(f[i, j]) * right[j] for i in range(len(left)) for j in range(len(right))), F.lit(0.0))


def latest_cross_section(x: DataFrame, as_of) -> DataFrame:
    """Rows of the latest date at or before as_of; ValueError if there is none."""
    day = x.where(F.col("Date") <= F.lit(as_of).cast("date")).agg(F.max("Date")).first()[0]
    if day is None:
        raise ValueError("no cross-section at or before as_of")
    return x.where(F.col("Date") == F.lit(day))


#: Rows of an asset covariance that a task makes, and the columns of the matrix (about) that it makes them for.
PAIRS_A_TASK, BLOCK = 4_000_000, 4_096


def asset_covariance(x_t: DataFrame, f: np.ndarray, d: DataFrame, factors: Sequence[str], *, most: int | None = None) -> DataFrame:
    """t1, t2, cov of every pair of one cross-section: only where the whole matrix is asked for. It has a row for each pair,
    made by as many tasks as they need. A caller may say for how many assets that is meant (`most`); ValueError where there
    are more.

    A task makes a tile: some assets against a block of others, both in the order of their factors. So a file of the result
    has few different tickers, whatever the number of assets, and assets of equal factors give runs of equal values: what
    is written stays near the 8 bytes of a value, or well below."""
    n = x_t.count()
    if most is not None and n > most:
        raise ValueError(f"a covariance of {n} assets has {n * n} rows; at most {most} assets were asked for")
    k = len(factors)
    own = x_t.select("Ticker", *factors).join(d.select("Ticker", "specific_var"), "Ticker", "left")
    order = [*factors, "Ticker"]
    dealt = own.repartitionByRange(max(1, -(-n // BLOCK)), *order).sortWithinPartitions(*order)
    own = stored(dealt.select("*", F.spark_partition_id().alias("block")), "assets")
    b = own.select("block", F.col("Ticker").alias("t2"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(factors)])
    loaded = [sum((F.col(factors[i]) * float(f[i, j]) for i in range(k)), F.lit(0.0)).alias(f"a{j}") for j in range(k)]
    a = own.select(F.col("Ticker").alias("t1"), *loaded, F.coalesce("specific_var", F.lit(0.0)).alias("v"))
    a = a.crossJoin(F.broadcast(b.select("block").distinct())).repartitionByRange(max(1, min(n, -(-n * n // PAIRS_A_TASK))), "block", *[f"a{j}" for j in range(k)], "t1")
    value = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(k)), F.lit(0.0)) + F.when(F.col("t1") == F.col("t2"), F.col("v")).otherwise(0.0)
    return a.join(F.broadcast(b) if n * (k + 1) <= BROADCAST_NUMBERS else b, "block").select("t1", "t2", value.alias("cov"))


#: Points at which eigenvalues are counted in one look at the assets, and how many looks at the most.
_POINTS, _LOOKS = 64, 16


def smallest_asset_eigenvalue(held: DataFrame, f: np.ndarray, factors: Sequence[str]) -> float:
    """Of E f E' + D, whose rows are assets with the factors as columns and specific_var (their D); all complete.

    The matrix is never made. How many of its eigenvalues lie below a point follows, by Sylvester's law of inertia, from a
    K x K sum over assets, E'(D - point)^-1 E; each look works such sums out for many points and keeps the gap between two
    of them in which the count leaves 0."""
    values, vectors = np.linalg.eigh((f + f.T) / 2)
    kept = np.abs(values) > 1e-15 * max(np.abs(values).max(), 1e-300)
    values, turn = values[kept], vectors[:, kept]
    k = len(values)
    upper = np.triu_indices(k)
    v = F.col("specific_var")
    square = sum((F.col(c) * F.col(c) for c in factors), F.lit(0.0))
    columns = [F.col(c) for c in factors]
    facts = held.agg(F.min(v).alias("d"), F.min(v + quadratic(columns, f, columns)).alias("diagonal"), F.sum(square).alias("square")).first()
    # no eigenvalue is below the smallest variance (but for negative ones of f), one is at or below the smallest diagonal cell
    low, high = facts["d"] + min(0.0, values.min(initial=0.0)) * facts["square"], facts["diagonal"]
    if k == 0 or not high > low:
        return float(low)

    def sums_at(points: np.ndarray):
        def sums(batches):
            import pandas as pd

            below, total = np.zeros(len(points)), np.zeros((len(points), len(upper[0])))
            for pdf in batches:
                gap = pdf["specific_var"].to_numpy(float)[:, None] - points
                gap[gap == 0] = 1e-300 ** 0.5
                e = pdf[list(factors)].to_numpy(float) @ turn
                below += (gap < 0).sum(axis=0)
                total += (1 / gap).T @ (e[:, upper[0]] * e[:, upper[1]])
            yield pd.DataFrame({"below": [below], "total": [total.ravel()]})

        return sums

    for _ in range(_LOOKS):
        points = np.linspace(low, high, _POINTS + 2)[1:-1]
        if not high - low > 1e-12 * max(abs(low), abs(high)) or not (points[0] > low and points[-1] < high):
            break
        rows = held.select("specific_var", *factors).mapInPandas(sums_at(points), "below array<double>, total array<double>").collect()  # a row a task
        below = np.sum([r["below"] for r in rows], axis=0)
        total = np.sum([r["total"] for r in rows], axis=0).reshape(len(points), -1)
        inner = np.zeros((len(points), k, k))
        inner[:, upper[0], upper[1]] = inner[:, upper[1], upper[0]] = -total
        inner[:, np.arange(k), np.arange(k)] -= 1 / values
        count = below + (np.linalg.eigvalsh(inner) < 0).sum(axis=1) - (values > 0).sum()
        first = int(np.argmax(count >= 1)) if (count >= 1).any() else len(points)
        low, high = (points[first - 1] if first else low), (points[first] if first < len(points) else high)
    return float(low)


def asset_volatility(x: DataFrame, f: np.ndarray, d: DataFrame, factors: Sequence[str], annualization: int = 252) -> DataFrame:
    """The keys of x and vol, from the diagonal alone; a ticker without specific variance has 0."""
    columns = [F.col(c) for c in factors]
    variance = quadratic(columns, f, columns) + F.coalesce("specific_var", F.lit(0.0))
    return x.join(d, "Ticker", "left").select(*[c for c in KEYS if c in x.columns], F.sqrt(variance * annualization).alias("vol"))


def portfolio_exposure(weights: DataFrame, x_t: DataFrame, factors: Sequence[str]) -> DataFrame:
    """factor, exposure: sums of weight times exposure; NULL where a ticker has no weight or no exposure."""
    held = x_t.join(weights, "Ticker", "left")
    value = lambda c: F.when(F.count_if(F.col("weight").isNull() | F.col(c).isNull()) == 0, F.sum(F.col("weight") * F.col(c)))
    return held.agg(*[value(c).alias(c) for c in factors]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("exposure")) for c in factors])))


def risk_decomposition(weights: DataFrame, x_t: DataFrame, f: np.ndarray, d: DataFrame, factors: Sequence[str], annualization: int = 252) -> DataFrame:
    """One row: total, factor and specific variance, their shares, annualized volatility."""
    held = x_t.join(weights, "Ticker", "left").join(d, "Ticker", "left")
    sums = held.agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in factors], F.sum(F.col("weight") ** 2 * F.col("specific_var")).alias("specific_variance"))
    e = [F.col(c) for c in factors]
    both = sums.select(quadratic(e, f, e).alias("factor_variance"), "specific_variance").withColumn("total_variance", F.col("factor_variance") + F.col("specific_variance"))
    return both.select("total_variance", "factor_variance", "specific_variance", safe_div(F.col("factor_variance"), F.col("total_variance")).alias("factor_pct"), safe_div(F.col("specific_variance"), F.col("total_variance")).alias("specific_pct"), F.sqrt(F.col("total_variance") * annualization).alias("volatility"))


def realized_volatility(r: DataFrame, window: int = 60, annualization: int = 252) -> DataFrame:
    """Date, Ticker, realized_vol: rolling sample deviation, with half a window (at least 2) of values."""
    return r.select(*KEYS, (full_window(F.stddev_samp, F.col("r"), window, max(window // 2, 2)) * annualization**0.5).alias("realized_vol"))


def volatility_selfcheck(x: DataFrame, f: np.ndarray, d: DataFrame, r: DataFrame, factors: Sequence[str], *, window: int = 60, min_history: int = 120, annualization: int = 252) -> DataFrame:
    """Date, n_assets, model_vol_mean, realized_vol_mean, abs_error_mean, rel_error_mean, from the date numbered min_history
    (0 the first) on; dates of fewer than ten tickers are left out. ValueError if there are fewer dates than min_history."""
    dates = x.select("Date").distinct()
    if dates.count() < min_history:
        raise ValueError("not enough dates for min_history")
    late = dates.select("Date", F.row_number().over(Window.orderBy("Date")).alias("i")).where(F.col("i") > min_history).select("Date")
    model = asset_volatility(x.join(late, "Date", "left_semi"), f, d, factors, annualization)
    both = model.join(realized_volatility(r, window, annualization), list(KEYS))
    error = F.abs(F.col("vol") - F.col("realized_vol"))
    out = both.groupBy("Date").agg(F.count("*").alias("n_assets"), F.avg("vol").alias("model_vol_mean"), F.avg("realized_vol").alias("realized_vol_mean"), F.avg(error).alias("abs_error_mean"), F.avg(safe_div(error, F.col("realized_vol"))).alias("rel_error_mean"))
    return out.where("n_assets >= 10")


def factor_attribution(x_t: DataFrame, weights: DataFrame, returns: Mapping[str, float]) -> DataFrame:
    """factor, contribution: exposure times the factor's return on one date."""
    rates = F.create_map(*[v for k, x in returns.items() for v in (F.lit(k), F.lit(float(x)))])
    return portfolio_exposure(weights, x_t, list(returns)).select("factor", (F.col("exposure") * rates[F.col("factor")]).alias("contribution"))
