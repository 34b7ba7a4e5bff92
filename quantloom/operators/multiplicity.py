"""What is left of a result once the number of trials is counted: deflated Sharpe ratios and false discoveries.

Normal probabilities and quantiles are expressions that Spark compiles; they are written as SQL text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import null_nan

# Fixed values. Of the normal distribution function (Abramowitz and Stegun 26.2.17), error below 7.5e-8:
_CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_CDF_STEP = 0.2316419
# Of its quantiles, rational in the middle and in the tails (Acklam), relative error below 1.15e-9:
_MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425
_EULER = 0.5772156649015329


def _polynomial(coefficients, x: str) -> str:
    """By Horner's rule, the highest power first."""
    out = f"({coefficients[0]!r}e0)" if "e" not in repr(coefficients[0]) else f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return out


def normal_cdf(x: str) -> str:
    """SQL text for the probability that a normal variable is at most x (itself SQL text)."""
    t = f"(1e0 / (1 + {_CDF_STEP}e0 * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r}e0 * {_polynomial((*reversed(_CDF), 0.0), t)})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


def normal_quantile(p: str) -> str:
    """SQL text for the quantile at p, above 0 and below 1."""
    tail = lambda q: f"({_polynomial(_TAIL_OVER, q)} / {_polynomial(_TAIL_UNDER, q)})"
    q, low, high = f"(({p}) - 0.5e0)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    r = f"({q} * {q})"
    return f"(CASE WHEN {p} < {_TAIL}e0 THEN {tail(low)} WHEN {p} > {1 - _TAIL}e0 THEN -{tail(high)} ELSE {_polynomial(_MIDDLE_OVER, r)} * {q} / {_polynomial(_MIDDLE_UNDER, r)} END)"


def expected_largest(n: str, variance: str) -> str:
    """SQL text for the expected largest of n independent Sharpe ratios of that variance around 0; 0 for a single one."""
    return f"(CASE WHEN {n} > 1 THEN sqrt({variance}) * ({1 - _EULER}e0 * {normal_quantile(f'(1 - 1e0 / {n})')} + {_EULER}e0 * {normal_quantile(f'(1 - 1e0 / ({n} * {math.e!r}e0))')}) ELSE 0e0 END)"


#: The probability that a Sharpe ratio is above a bar, given its series' length and moments (kurtosis of a normal one: 3).
DEFLATED = normal_cdf("((sharpe - bar) * sqrt(n - 1e0) / sqrt(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe))")


def deflated_sharpe(trials: DataFrame, *, value: str = "ret", by: str = "trial") -> DataFrame:
    """by, n, sharpe (a period's, not annualized), skewness, kurtosis, trials (their effective number), bar (the largest Sharpe
    ratio that chance alone would give among them) and deflated (the probability that the trial's is above it).

    trials: Date, by, value, each key once. The effective number is that of the correlations' spectrum: (sum of eigenvalues)^2
    over the sum of their squares, which is the number of trials squared over the sum of squared correlations, so that the
    spectrum itself isn't needed; pairs that share fewer than two dates count as uncorrelated. There is a row for each pair
    of trials and date on the way: trials are the few candidates of one choice, not rows of a panel. A series without
    dispersion has no Sharpe ratio and takes no part.
    """
    held = trials.select("Date", F.col(by).alias("t"), null_nan(F.col(value).cast("double")).alias("v")).where("v is not null and t is not null")
    each = held.groupBy("t").agg(F.count("*").alias("n"), F.try_divide(F.avg("v"), F.stddev_samp("v")).alias("sharpe"), F.skewness("v").alias("skewness"), (F.kurtosis("v") + 3).alias("kurtosis"), (F.min("v") < F.max("v")).alias("varied")).where("varied").drop("varied")
    kept = held.join(each.select("t"), "t", "left_semi")
    a, b = kept.select("Date", F.col("t").alias("a"), F.col("v").alias("x")), kept.select("Date", F.col("t").alias("b"), F.col("v").alias("y"))
    pairs = a.join(b, "Date").where("a < b").groupBy("a", "b").agg(F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0)).alias("c"))
    squares = pairs.agg(F.coalesce(2 * F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("squares"))
    facts = each.agg(F.count("*").alias("k"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("spread")).join(squares, how="cross")  # one row each
    facts = facts.select((F.col("k") * F.col("k") / (F.col("k") + F.col("squares"))).alias("trials"), "spread")
    facts = facts.select("trials", F.expr(expected_largest("trials", "spread")).alias("bar"))
    return each.join(facts, how="cross").select(F.col("t").alias(by), "n", "sharpe", "skewness", "kurtosis", "trials", "bar", F.expr(DEFLATED).alias("deflated"))


def false_discoveries(tests: DataFrame, *, t: str = "nw_t", by: str = "factor", rate: float = 0.05) -> DataFrame:
    """by, t, p (two-sided, normal), adjusted (Benjamini and Hochberg: the least rate of false discoveries at which this one is
    still reported) and discovery (adjusted is at most `rate`). Tests without a t are left out; a row a test."""
    held = tests.select(by, F.col(t).alias("t")).where(null_nan(F.col("t")).isNotNull()).withColumn("p", F.expr(f"2 * (1 - {normal_cdf('abs(t)')})"))
    order = Window.orderBy("p", by)
    ranked = held.withColumn("q", F.col("p") * F.count("*").over(Window.partitionBy()) / F.row_number().over(order))
    upward = Window.orderBy(F.desc("p"), F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("adjusted", F.least(F.min("q").over(upward), F.lit(1.0)))
    return out.select(by, F.col("t").alias(t), "p", "adjusted", (F.col("adjusted") <= rate).alias("discovery"))
