"""Registered queries of walk-forward portfolios and of the statistics around factors and returns, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import KEYS
from ..operators import decay, multiplicity, pairs, performance, premia, resampling, risk, statistical, tails
from ..operators.walkforward import WalkForwardConfig, rolling_covariance, walk_forward_report, walk_forward_returns, walk_forward_weights
from ..sources.scratch import stored
from .panel import panel
from .queries import MONTHS, X2, aligned, market, model, register, returns, rounded, validated

#: Two years of months for each window, held for a quarter.
WALK = WalkForwardConfig(window=24, rebalance=3, cap=0.30, annualization=MONTHS)
#: Prices of turnover, by the unit of variance: none, and two that slow trading down.
PRICES = (0.0, 0.005, 0.05)
COST = 0.0023
#: Months of a beta's window.
BETA_WINDOW = 24
LAMBDA = 0.94
BLOCK, REPLICATES = 6, 200
TAIL = 0.05


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, Ticker, r: what the two-factor model leaves of each return."""
    return stored(model(spark, sf_dir)[4].select(*KEYS, F.col("eps").alias("r")), "residuals")


# ---- walk-forward ---------------------------------------------------------------------------------------------------


@register(
    "walk_forward_covariance",
    f"""SELECT e.Date, a.Ticker AS t1, b.Ticker AS t2, round(covar_samp(a.v, b.v), 8) AS cov
    FROM (SELECT i, Date FROM days WHERE i >= {WALK.window} - 1 AND i + 1 < (SELECT COUNT(*) FROM days) - {WALK.rebalance} AND (i + 1 - {WALK.window}) % {WALK.rebalance} = 0) e
    JOIN grid a ON a.i > e.i - {WALK.window} AND a.i <= e.i JOIN grid b ON b.i = a.i GROUP BY e.Date, a.Ticker, b.Ticker""",
    "grid",
)
def _(spark, sf_dir):
    return rounded(rolling_covariance(residuals(spark, sf_dir), WALK), 8)


@register("walk_forward_weights")
def _(spark, sf_dir):
    return rounded(walk_forward_weights(residuals(spark, sf_dir), WALK, turnovers=PRICES))


@register("walk_forward_returns")
def _(spark, sf_dir):
    r = residuals(spark, sf_dir)
    return rounded(walk_forward_returns(r, stored(walk_forward_weights(r, WALK, turnovers=PRICES), "weights"), WALK, cost=COST))


@register("walk_forward_report")
def _(spark, sf_dir):
    r = residuals(spark, sf_dir)
    return rounded(walk_forward_report(r, stored(walk_forward_weights(r, WALK, turnovers=PRICES), "weights"), WALK, cost=COST))


# ---- statistical factors --------------------------------------------------------------------------------------------


@register("statistical_factors")
def _(spark, sf_dir):
    return rounded(statistical.statistical_factors(returns(spark, sf_dir), 5, correlation=True).loadings)


@register("statistical_spectrum")
def _(spark, sf_dir):
    return rounded(statistical.statistical_factors(returns(spark, sf_dir), 5, correlation=True).spectrum)


# ---- Fama-MacBeth ---------------------------------------------------------------------------------------------------


def _market_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = stored(returns(spark, sf_dir), "returns")
    return premia.fama_macbeth(r, market(spark, sf_dir).withColumnRenamed("ret", "market"), ["market"], window=BETA_WINDOW, lags=3)


@register("rolling_betas", "SELECT Date, Ticker, round(r, 6) AS r, round(market, 6) AS market FROM betas", "betas")
def _(spark, sf_dir):
    return rounded(_market_model(spark, sf_dir)["betas"])


@register("fama_macbeth_premia", "SELECT Date, round(const, 5) AS const, round(market, 5) AS market FROM premia", "premia")
def _(spark, sf_dir):
    return rounded(_market_model(spark, sf_dir)["premia"], 5)


def newey_west_sql(source: str, lags: int) -> str:
    """factor, nw_t of rows (factor, Date, v)."""
    terms = " + ".join(f"CASE WHEN least({lags}, n - 1) >= {k} THEN 2 * (1 - {k}e0 / (least({lags}, n - 1) + 1)) * g{k} ELSE 0 END" for k in range(1, lags + 1))
    sums = ", ".join(f"SUM(e * e{k}) AS g{k}" for k in range(1, lags + 1))
    before = ", ".join(f"LAG(e, {k}) OVER (PARTITION BY factor ORDER BY Date) AS e{k}" for k in range(1, lags + 1))
    return f"""SELECT factor, CASE WHEN n >= 2 AND lrv > 0 THEN m / sqrt(lrv / n) END AS nw_t FROM (SELECT factor, n, m, (g0 + {terms}) / n AS lrv FROM (SELECT factor, COUNT(*) AS n, AVG(v) AS m, SUM(e * e) AS g0, {sums}
        FROM (SELECT *, {before} FROM (SELECT factor, Date, v, v - AVG(v) OVER (PARTITION BY factor) AS e FROM ({source}) s WHERE v IS NOT NULL) a) b GROUP BY factor) c) d"""


_PREMIA = "SELECT 'const' AS factor, Date, const AS v FROM premia UNION ALL SELECT 'market', Date, market FROM premia"


@register("fama_macbeth", f"SELECT m.factor, n_dates, round(premium, 6) AS premium, round(nw_t, 4) AS nw_t FROM (SELECT factor, COUNT(v) AS n_dates, AVG(v) AS premium FROM ({_PREMIA}) p GROUP BY factor) m JOIN ({newey_west_sql(_PREMIA, 3)}) t ON m.factor = t.factor", "premia")
def _(spark, sf_dir):
    return rounded(_market_model(spark, sf_dir)["summary"], nw_t=4)


@register("fama_macbeth_k3")
def _(spark, sf_dir):
    r = stored(returns(spark, sf_dir), "returns")
    both = risk.factor_returns(aligned(spark, sf_dir), X2).join(market(spark, sf_dir).withColumnRenamed("ret", "market"), "Date", "full")
    return rounded(premia.fama_macbeth(r, both, ["market", *X2], window=BETA_WINDOW, lags=3)["summary"], nw_t=4)


# ---- exponential weights --------------------------------------------------------------------------------------------

_PAIRS = " UNION ALL ".join(f"SELECT '{p}' AS factor_i, '{q}' AS factor_j, {p} * {q} AS v, i, n FROM ranked" for p in X2 for q in X2)


@register("ewma_factor_cov", f"SELECT factor_i, factor_j, round(SUM(v * pow({LAMBDA}e0, n - i)) * {1 - LAMBDA:.2f}e0, 9) AS cov FROM (WITH ranked AS (SELECT *, row_number() OVER (ORDER BY Date) AS i, COUNT(*) OVER () AS n FROM fr WHERE f1 IS NOT NULL AND f2 IS NOT NULL) {_PAIRS}) p GROUP BY factor_i, factor_j", "fr")
def _(spark, sf_dir):
    return rounded(decay.ewma_covariance(risk.factor_returns(aligned(spark, sf_dir), X2), X2, LAMBDA), 9)


@register("ewma_volatility", f"SELECT Date, Ticker, round(sqrt(SUM(r * r * pow({LAMBDA}e0, -i)) OVER w * pow({LAMBDA}e0, i) * {1 - LAMBDA:.2f}e0 * 12), 6) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS i FROM ret WHERE r IS NOT NULL) s WINDOW w AS (PARTITION BY Ticker ORDER BY Date ROWS UNBOUNDED PRECEDING)", "ret")
def _(spark, sf_dir):
    return rounded(decay.ewma_volatility(returns(spark, sf_dir), LAMBDA, annualization=MONTHS))


# ---- resampling and tails -------------------------------------------------------------------------------------------

_WEIGHT = " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in resampling.poisson_limits())


@register(
    "ic_bootstrap",
    f"""SELECT t.factor, n, round(mean, 6) AS mean, round(error, 6) AS error, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT factor, CAST(SUM(n) AS BIGINT) AS n, SUM(s) / SUM(n) AS mean FROM blocks GROUP BY factor) t LEFT JOIN
    (SELECT factor, stddev_samp(m) AS error, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT factor, r, SUM(w * s) / SUM(w * n) AS m FROM
        (SELECT *, {_WEIGHT} AS w FROM (SELECT *, CAST('0x' || substr(md5('1:' || r || ':' || block), 1, 8) AS BIGINT) AS u FROM blocks, range(1, {REPLICATES + 1}) g(r)) d) x WHERE w > 0 GROUP BY factor, r) y GROUP BY factor) q ON t.factor = q.factor""",
    "blocks",
)
def _(spark, sf_dir):
    return rounded(resampling.block_bootstrap(validated(spark, sf_dir)["daily"], "rank_ic", block=BLOCK, replicates=REPLICATES, level=0.95, seed=1))


_Z = NormalDist().inv_cdf(TAIL)
_MOMENTS = "SELECT COUNT(r) AS n, AVG(r) AS m, stddev_samp(r) AS s, AVG(d * d) AS m2, AVG(d * d * d) AS m3, AVG(d * d * d * d) AS m4, any_value(q) AS q, AVG(CASE WHEN r <= q THEN r END) AS t FROM (SELECT r, r - AVG(r) OVER () AS d, q FROM ret, (SELECT quantile_cont(r, {0}) AS q FROM ret) z WHERE r IS NOT NULL) c".format(TAIL)


@register("tail_risk", f"""SELECT 'r' AS name, n, round(-q, 6) AS value_at_risk, round(-t, 6) AS tail_expectation, round(-(m + {_Z}e0 * s), 6) AS normal_var,
    round(-(m + s * ({_Z}e0 + {_Z**2 - 1}e0 / 6 * k + {_Z**3 - 3 * _Z}e0 / 24 * x - {2 * _Z**3 - 5 * _Z}e0 / 36 * k * k)), 6) AS modified_var, round(k, 6) AS skewness, round(x, 6) AS excess_kurtosis FROM (SELECT *, m3 / pow(m2, 1.5) AS k, m4 / (m2 * m2) - 3 AS x FROM ({_MOMENTS}) a) b""", "ret")
def _(spark, sf_dir):
    return rounded(tails.tail_risk(returns(spark, sf_dir), ["r"], TAIL))


_RUNNING = "SELECT *, MAX(wealth) OVER (PARTITION BY Ticker ORDER BY Date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT Ticker, Date, r / 10 AS r, b, exp(SUM(ln(1 + r / 10)) OVER (PARTITION BY Ticker ORDER BY Date ROWS UNBOUNDED PRECEDING)) AS wealth FROM ret JOIN (SELECT Date, AVG(r) / 10 AS b FROM ret WHERE r IS NOT NULL GROUP BY Date) m USING (Date) WHERE r IS NOT NULL) w"


@register("performance_ratios", f"""SELECT Ticker, n, round(g, 6) AS annual_return, round(d, 6) AS downside, round(m * 12 / NULLIF(d, 0), 6) AS sortino, round(dd, 6) AS max_drawdown, round(g / NULLIF(-dd, 0), 6) AS calmar,
    round(te, 6) AS tracking_error, round(a * 12 / NULLIF(te, 0), 6) AS information_ratio, round(k, 6) AS kelly, round(greatest(k, 0) / 2, 6) AS held_kelly
    FROM (SELECT Ticker, COUNT(*) AS n, exp(SUM(ln(1 + r)) * 12 / COUNT(*)) - 1 AS g, AVG(r) AS m, sqrt(AVG(least(r, 0) * least(r, 0)) * 12) AS d, MIN(wealth / peak - 1) AS dd, AVG(r - b) AS a, stddev_samp(r - b) * sqrt(12e0) AS te,
          CASE WHEN COUNT(*) > 1 THEN AVG(r) / NULLIF(var_samp(r), 0) END AS k FROM ({_RUNNING}) x GROUP BY Ticker) s""", "ret")
def _(spark, sf_dir):
    r = stored(returns(spark, sf_dir).select(*KEYS, (F.col("r") / 10).alias("r")), "returns")
    return rounded(performance.performance_ratios(r, market(spark, sf_dir).withColumnRenamed("ret", "r"), periods=MONTHS))


# ---- how many were tried --------------------------------------------------------------------------------------------

_EACH = "SELECT factor, COUNT(*) AS n, AVG(v) / stddev_samp(v) AS sharpe, AVG(d * d * d) / pow(AVG(d * d), 1.5) AS skewness, AVG(d * d * d * d) / pow(AVG(d * d), 2) AS kurtosis FROM (SELECT factor, spread AS v, spread - AVG(spread) OVER (PARTITION BY factor) AS d FROM spreads) c GROUP BY factor"
_SQUARES = "SELECT COALESCE(2 * SUM(c * c), 0) AS squares FROM (SELECT corr(x.spread, y.spread) AS c FROM spreads x JOIN spreads y ON x.Date = y.Date AND x.factor < y.factor GROUP BY x.factor, y.factor) p"


@register(
    "deflated_sharpe",
    f"""SELECT factor, n, round(sharpe, 6) AS sharpe, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(trials, 5) AS trials, round(bar, 6) AS bar, round({multiplicity.DEFLATED}, 6) AS deflated FROM
    (SELECT e.*, trials, {multiplicity.expected_largest("trials", "spread")} AS bar FROM (SELECT * FROM ({_EACH}) s, (SELECT k * k / (k + squares) AS trials, spread FROM (SELECT COUNT(*) AS k, var_samp(sharpe) AS spread FROM ({_EACH}) t) u, ({_SQUARES}) q) f) e) g""",
    "spreads",
)
def _(spark, sf_dir):
    spreads = stored(validated(spark, sf_dir)["quantiles"].select("Date", "factor", "spread"), "spreads")
    return rounded(multiplicity.deflated_sharpe(spreads, value="spread", by="factor"), trials=5)


@register("false_discoveries", f"""SELECT factor, round(nw_t, 6) AS nw_t, round(p, 6) AS p, round(least(MIN(q) OVER (ORDER BY p DESC, factor DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS adjusted, least(MIN(q) OVER (ORDER BY p DESC, factor DESC ROWS UNBOUNDED PRECEDING), 1) <= 0.05 AS discovery
    FROM (SELECT *, p * COUNT(*) OVER () / row_number() OVER (ORDER BY p, factor) AS q FROM (SELECT factor, nw_t, 2 * (1 - {multiplicity.normal_cdf("abs(nw_t)")}) AS p FROM nw WHERE nw_t IS NOT NULL) a) b""", "nw")
def _(spark, sf_dir):
    return rounded(multiplicity.false_discoveries(stored(validated(spark, sf_dir)["summary"].select("factor", "nw_t"), "tests")))


@register("cointegrated_pairs")
def _(spark, sf_dir):
    return rounded(pairs.cointegrated_pairs(pairs.log_prices(panel(spark, sf_dir))), 5)
