"""The registered queries of the panel engine, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import KEYS, safe_div
from ..operators import portfolio, risk, validation
from ..operators.factors import Liquidity, Momentum, Volatility, compute_raw_exposures, standard_factors
from ..operators.joins import duplicate_keys
from ..operators.transforms import neutralize, orthogonalize, winsorize, winsorize_pooled, zscore
from ..sources.scratch import stored
from ..sources.tables import describe_columns, pivot_descriptors
from .panel import monthly, panel, quarterly, table
from .pipeline import exposure_statistics, get_exposures

#: Parameters in months.
FACTORS = standard_factors(Momentum(lookback_days=12, skip_days=1), Volatility(window_days=6, annualization=12), Liquidity(window_days=6))
NAMES = [f.name for f in FACTORS]
CONFIG = validation.ValidationConfig(horizon=1, annualization=12)
MONTHS = 12
AS_OF = "2000-12-31"
EVENTS = ("click", "view", "purchase", "signup", "error")
X2 = ["f1", "f2"]
X3 = ["value", "earn_yld", "beta"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL: named subqueries; each query takes those it needs -------------------------------------------------------

PARTS = {
    "monthly": ("", """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS Date, s_name AS Ticker, SUM(l_extendedprice) / SUM(l_quantity) AS px_last, SUM(l_extendedprice) AS market_cap,
        SUM(l_extendedprice) / NULLIF(SUM(l_extendedprice * (1 - l_discount)), 0) AS pb, AVG(l_discount) - 0.05e0 AS earn_yld, AVG(l_tax) / 0.04e0 AS beta, SUM(l_quantity) AS volume,
        MAX(r_name) AS gics_sector, MAX(n_name) AS gics_industry_group, MAX(s_name) AS gics_sub_industry
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE), s_name"""),
    "quarterly": ("", """SELECT Date, Ticker, sales / NULLIF(LAG(sales) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS growth_sales, net / NULLIF(LAG(net) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS growth_eps,
        returned / NULLIF(sales - returned, 0) AS leverage
        FROM (SELECT CAST(date_trunc('quarter', l_shipdate) + INTERVAL '4' MONTH AS DATE) AS Date, s_name AS Ticker, SUM(l_extendedprice) AS sales, SUM(l_extendedprice * (1 - l_discount)) AS net,
              SUM(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0e0 END) AS returned FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
              GROUP BY CAST(date_trunc('quarter', l_shipdate) + INTERVAL '4' MONTH AS DATE), s_name) g"""),
    "panel": ("monthly quarterly", "SELECT m.*, q.growth_sales, q.growth_eps, q.leverage FROM monthly m ASOF LEFT JOIN quarterly q ON m.Ticker = q.Ticker AND m.Date >= q.Date"),
    "raw": ("panel", """SELECT Date, Ticker, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS size, CASE WHEN pb > 0 THEN -ln(pb) END AS value, earn_yld,
        LAG(p, 1) OVER t / NULLIF(LAG(p, 12) OVER t, 0) - 1 AS momentum, CASE WHEN COUNT(ret) OVER w = 6 THEN stddev_pop(ret) OVER w * sqrt(12e0) END AS volatility, beta,
        CASE WHEN COUNT(v) OVER w = 6 THEN ln(AVG(v) OVER w) END AS liquidity, growth_sales, growth_eps, leverage
        FROM (SELECT *, p / NULLIF(LAG(p) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS ret FROM (SELECT *, CASE WHEN px_last > 0 THEN px_last END AS p, CASE WHEN volume > 0 THEN volume END AS v FROM panel) a) b
        WINDOW t AS (PARTITION BY Ticker ORDER BY Date), w AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""),
    "long": ("raw", "SELECT Date, Ticker, factor, x FROM (" + " UNION ALL ".join(f"SELECT Date, Ticker, '{n}' AS factor, {n} AS x FROM raw" for n in NAMES) + ") u"),
    "wins": ("long", """SELECT l.Date, Ticker, l.factor, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x
        FROM long l JOIN (SELECT Date, factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM long GROUP BY Date, factor) q ON l.Date = q.Date AND l.factor = q.factor"""),
    "zs": ("long", "SELECT Date, Ticker, factor, CASE WHEN MIN(x) OVER d < MAX(x) OVER d THEN (x - AVG(x) OVER d) / NULLIF(stddev_pop(x) OVER d, 0) END AS x FROM long WINDOW d AS (PARTITION BY Date, factor)"),
    "wz": ("wins", "SELECT Date, Ticker, factor, CASE WHEN MIN(x) OVER d < MAX(x) OVER d THEN (x - AVG(x) OVER d) / NULLIF(stddev_pop(x) OVER d, 0) END AS x FROM wins WINDOW d AS (PARTITION BY Date, factor)"),
    "fwd": ("panel", "SELECT Date, Ticker, LEAD(px_last, 1) OVER t / NULLIF(px_last, 0) - 1 AS y FROM panel WINDOW t AS (PARTITION BY Ticker ORDER BY Date)"),
    "xy": ("wz fwd", "SELECT z.Date, z.Ticker, z.factor, round(x, 9) AS x, y FROM wz z LEFT JOIN fwd f ON z.Date = f.Date AND z.Ticker = f.Ticker"),
    "daily": ("xy", """SELECT d.Date, d.factor, CASE WHEN n >= 20 THEN ic END AS ic, CASE WHEN n >= 20 THEN rank_ic END AS rank_ic FROM (SELECT DISTINCT Date, factor FROM xy) d LEFT JOIN
        (SELECT Date, factor, COUNT(*) AS n, CASE WHEN MIN(x) < MAX(x) AND MIN(y) < MAX(y) THEN covar_pop(x, y) / NULLIF(stddev_pop(x) * stddev_pop(y), 0) END AS ic,
                CASE WHEN MIN(rx) < MAX(rx) AND MIN(ry) < MAX(ry) THEN covar_pop(rx, ry) / NULLIF(stddev_pop(rx) * stddev_pop(ry), 0) END AS rank_ic
         FROM (SELECT *, rank() OVER (PARTITION BY Date, factor ORDER BY x) + (COUNT(*) OVER (PARTITION BY Date, factor, x) - 1) / 2e0 AS rx,
                      rank() OVER (PARTITION BY Date, factor ORDER BY y) + (COUNT(*) OVER (PARTITION BY Date, factor, y) - 1) / 2e0 AS ry FROM xy WHERE x IS NOT NULL AND y IS NOT NULL) r
         GROUP BY Date, factor) s ON d.Date = s.Date AND d.factor = s.factor"""),
    "nw": ("daily", """SELECT factor, CASE WHEN n >= 2 AND lrv > 0 THEN m / sqrt(lrv / n) END AS nw_t FROM (SELECT factor, n, m, (g0 + """ + " + ".join(f"CASE WHEN least(5, n - 1) >= {k} THEN 2 * (1 - {k}e0 / (least(5, n - 1) + 1)) * g{k} ELSE 0 END" for k in range(1, 6)) + """) / n AS lrv
        FROM (SELECT factor, COUNT(*) AS n, AVG(v) AS m, SUM(e * e) AS g0, """ + ", ".join(f"SUM(e * e{k}) AS g{k}" for k in range(1, 6)) + " FROM (SELECT *, " + ", ".join(f"LAG(e, {k}) OVER (PARTITION BY factor ORDER BY Date) AS e{k}" for k in range(1, 6)) + """
              FROM (SELECT factor, Date, rank_ic AS v, rank_ic - AVG(rank_ic) OVER (PARTITION BY factor) AS e FROM daily WHERE rank_ic IS NOT NULL) a) b GROUP BY factor) c) d"""),
    "buckets": ("xy", """SELECT Date, factor, y, greatest(((r - 1) * 5 + n - 2) // (n - 1), 1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY Date, factor ORDER BY x, Ticker) AS r, COUNT(*) OVER d AS n, MIN(x) OVER d AS lo, MAX(x) OVER d AS hi
        FROM xy WHERE x IS NOT NULL AND y IS NOT NULL WINDOW d AS (PARTITION BY Date, factor)) s WHERE n >= 20 AND lo < hi"""),
    "spreads": ("buckets", "SELECT *, q5 - q1 AS spread FROM (SELECT Date, factor, " + ", ".join(f"AVG(CASE WHEN b = {k} THEN y END) AS q{k}" for k in range(1, 6)) + " FROM buckets GROUP BY Date, factor) s"),
    "summary": ("daily nw xy spreads", """SELECT s.factor, n_dates, mean_ic, mean_rank_ic, CASE WHEN sd_ic > 0 THEN mean_ic / sd_ic * sqrt(12e0) END AS icir, CASE WHEN sd_rank_ic > 0 THEN mean_rank_ic / sd_rank_ic * sqrt(12e0) END AS rank_icir, nw_t, coverage, mean_spread,
        CASE WHEN abs(mean_rank_ic) >= 0.03 AND abs(nw_t) >= 2 AND coverage >= 0.7 AND n_dates >= 60 THEN 'accepted' WHEN abs(mean_rank_ic) >= 0.01 AND coverage >= 0.5 THEN 'candidate' ELSE 'rejected' END AS status
        FROM (SELECT factor, COUNT(rank_ic) AS n_dates, AVG(ic) AS mean_ic, stddev_samp(ic) AS sd_ic, AVG(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS sd_rank_ic FROM daily GROUP BY factor) s
        JOIN (SELECT factor, COALESCE(COUNT(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END)::DOUBLE / NULLIF(COUNT(y), 0), 0) AS coverage FROM xy GROUP BY factor) c ON s.factor = c.factor
        LEFT JOIN nw ON s.factor = nw.factor LEFT JOIN (SELECT factor, AVG(spread) AS mean_spread FROM spreads GROUP BY factor) p ON s.factor = p.factor"""),
    "ret": ("panel", "SELECT Date, Ticker, px_last / NULLIF(LAG(px_last) OVER t, 0) - 1 AS r FROM panel WINDOW t AS (PARTITION BY Ticker ORDER BY Date)"),
    "x2": ("zs", "SELECT Date, Ticker, MAX(CASE WHEN factor = 'value' THEN x END) AS f1, MAX(CASE WHEN factor = 'earn_yld' THEN x END) AS f2 FROM zs WHERE factor IN ('value', 'earn_yld') GROUP BY Date, Ticker"),
    "al": ("x2 ret", "SELECT x.*, r FROM x2 x JOIN ret ON x.Date = ret.Date AND x.Ticker = ret.Ticker WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND r IS NOT NULL"),
    "fr": ("al", """SELECT Date, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS f1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS f2
        FROM (SELECT Date, SUM(f1 * f1) AS a11, SUM(f1 * f2) AS a12, SUM(f2 * f2) AS a22, SUM(f1 * r) AS b1, SUM(f2 * r) AS b2, COUNT(*) AS n FROM al GROUP BY Date) s WHERE n >= 3"""),
    "eps": ("al fr", "SELECT a.Date, a.Ticker, r - a.f1 * fr.f1 - a.f2 * fr.f2 AS eps FROM al a LEFT JOIN fr ON a.Date = fr.Date"),
    "mom": ("fr", """SELECT COUNT(*) AS n, AVG(x * x) AS s11, AVG(x * y) AS s12, AVG(y * y) AS s22, AVG(x * x * x * x) AS t11, AVG(x * x * y * y) AS t12, AVG(y * y * y * y) AS t22 FROM (SELECT f1 - AVG(f1) OVER () AS x, f2 - AVG(f2) OVER () AS y FROM fr) c"""),
    "lw": ("mom", """SELECT s11, s12, s22, mu, CASE WHEN least(beta, delta) > 0 THEN least(beta, delta) / delta ELSE 0 END AS s FROM (SELECT *, (s11 + s22) / 2 AS mu, (s11 * s11 + 2 * s12 * s12 + s22 * s22 - 2 * ((s11 + s22) / 2) * ((s11 + s22) / 2)) / 2 AS delta,
        (t11 + 2 * t12 + t22 - (s11 * s11 + 2 * s12 * s12 + s22 * s22)) / (2 * n) AS beta FROM mom) b"""),
    "f": ("lw", "SELECT (1 - s) * s11 + s * mu AS c11, (1 - s) * s12 AS c12, (1 - s) * s22 + s * mu AS c22 FROM lw"),
    "d": ("eps", "SELECT Ticker, COALESCE(v, AVG(v) OVER ()) AS specific_var FROM (SELECT Ticker, var_samp(eps) AS v FROM eps GROUP BY Ticker) a"),
    "xt": ("x2", f"SELECT * FROM x2 WHERE Date = (SELECT MAX(Date) FROM x2 WHERE Date <= DATE '{AS_OF}')"),
    "w": ("xt", "SELECT Ticker, 1e0 / COUNT(*) OVER () AS weight FROM xt"),
    "model": ("x2 f d", "SELECT Date, x.Ticker, sqrt((f1 * f1 * c11 + 2 * f1 * f2 * c12 + f2 * f2 * c22 + COALESCE(specific_var, 0)) * 12) AS vol FROM x2 x CROSS JOIN f LEFT JOIN d ON x.Ticker = d.Ticker"),
    "days": ("eps", "SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i FROM (SELECT DISTINCT Date FROM eps) d"),
    "grid": ("days eps", "SELECT d.i, t.Ticker, COALESCE(eps, 0) AS v FROM days d CROSS JOIN (SELECT DISTINCT Ticker FROM eps) t LEFT JOIN eps e ON e.Date = d.Date AND e.Ticker = t.Ticker"),
    "betas": ("ret", """SELECT r.Date, r.Ticker, r, CASE WHEN COUNT(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w = 24 THEN covar_pop(r, m) OVER w / NULLIF(var_pop(m) OVER w, 0) END AS market
        FROM (SELECT Date, Ticker, ret.r, CASE WHEN ret.r IS NOT NULL THEN k.m END AS m FROM ret LEFT JOIN (SELECT Date, AVG(r) / 10 AS m FROM ret WHERE r IS NOT NULL GROUP BY Date) k USING (Date)) r WINDOW w AS (PARTITION BY r.Ticker ORDER BY r.Date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""),
    "premia": ("betas", "SELECT Date, CASE WHEN COUNT(*) >= 3 THEN regr_intercept(r, market) END AS const, CASE WHEN COUNT(*) >= 3 THEN regr_slope(r, market) END AS market FROM betas WHERE r IS NOT NULL AND market IS NOT NULL GROUP BY Date"),
    "blocks": ("daily", """SELECT factor, block, COUNT(*) AS n, SUM(rank_ic) AS s FROM daily JOIN (SELECT Date, (row_number() OVER (ORDER BY Date) - 1) // 6 AS block FROM (SELECT DISTINCT Date FROM daily WHERE rank_ic IS NOT NULL) c) b USING (Date)
        WHERE rank_ic IS NOT NULL GROUP BY factor, block"""),
    "rv": ("ret", "SELECT Date, Ticker, CASE WHEN COUNT(r) OVER w >= 6 THEN stddev_samp(r) OVER w * sqrt(12e0) END AS realized_vol FROM ret WINDOW w AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
}


def sql(text: str, *parts: str) -> str:
    needed: list[str] = []

    def need(p: str) -> None:
        for q in PARTS[p][0].split():
            need(q)
        if p not in needed:
            needed.append(p)

    for p in parts:
        need(p)
    return ("WITH " + ", ".join(f"{p} AS ({PARTS[p][1]})" for p in needed) + " " if needed else "") + text


def register(name: str, text: str = "", *parts: str):
    def wrap(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = sql(text, *parts)
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


CAPS = {"px_last": 9, "market_cap": 2, "volume": 2}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_raw_exposures(panel(spark, sf_dir), FACTORS)


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winsorized and standardized exposures; each step reads the raw ones again, so they are stored."""
    return zscore(winsorize(stored(raw(spark, sf_dir), "raw")))


def longer(x: DataFrame) -> DataFrame:
    return rounded(x.unpivot(list(KEYS), [c for c in x.columns if c not in KEYS], "factor", "x"))


LONG = f"SELECT Date, Ticker, factor, {r6('x')} FROM "


@register("panel_build", f"SELECT Date, Ticker, round(px_last, 9) AS px_last, round(market_cap, 2) AS market_cap, {r6('pb', 'earn_yld', 'beta')}, round(volume, 2) AS volume, {r6('growth_sales', 'growth_eps', 'leverage')}, gics_sector, gics_industry_group, gics_sub_industry FROM panel", "panel")
def _(spark, sf_dir):
    return rounded(panel(spark, sf_dir), **CAPS)


@register("asof_descriptors", f"SELECT Date, Ticker, {r6('growth_sales', 'growth_eps', 'leverage')} FROM panel", "panel")
def _(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select(*KEYS, "growth_sales", "growth_eps", "leverage"))


@register("quarterly_descriptors", f"SELECT Date, Ticker, {r6('growth_sales', 'growth_eps', 'leverage')} FROM quarterly", "quarterly")
def _(spark, sf_dir):
    return rounded(quarterly(spark, sf_dir))


@register("panel_eav_pivot", "SELECT CAST(ts AS DATE) AS Date, CAST(user_id AS VARCHAR) AS Ticker, " + ", ".join(f"round(AVG(CASE WHEN event_type = '{e}' THEN value END), 6) AS {e}_mean" for e in EVENTS) + f" FROM events WHERE event_type IN {EVENTS} GROUP BY 1, 2")
def _(spark, sf_dir):
    long = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("field"), "value")
    return rounded(pivot_descriptors(long, {e: f"{e}_mean" for e in EVENTS}))


def one_factor(i: int) -> Callable[[SparkSession, str], DataFrame]:
    f = FACTORS[i]
    return lambda spark, sf_dir: rounded(compute_raw_exposures(panel(spark, sf_dir), [f]))


for _i, _f in enumerate(FACTORS):
    register(_f.name if _f.name != "momentum" else "momentum_12_1", f"SELECT Date, Ticker, {r6(_f.name)} FROM raw", "raw")(one_factor(_i))


@register("raw_exposures", f"SELECT Date, Ticker, {r6(*NAMES)} FROM raw", "raw")
def _(spark, sf_dir):
    return rounded(raw(spark, sf_dir))


@register("winsorize", LONG + "wins", "wins")
def _(spark, sf_dir):
    return longer(winsorize(raw(spark, sf_dir)))


@register("zscore", LONG + "zs", "zs")
def _(spark, sf_dir):
    return longer(zscore(raw(spark, sf_dir)))


@register("winsor_zscore", LONG + "wz", "wz")
def winsor_zscore(spark, sf_dir):
    return longer(standardized(spark, sf_dir))


@register("zscore_min_stocks", "SELECT Date, Ticker, round(CASE WHEN COUNT(beta) OVER d >= 100 AND MIN(beta) OVER d < MAX(beta) OVER d THEN (beta - AVG(beta) OVER d) / NULLIF(stddev_pop(beta) OVER d, 0) END, 6) AS beta FROM panel WINDOW d AS (PARTITION BY Date)", "panel")
def _(spark, sf_dir):
    return rounded(zscore(panel(spark, sf_dir).select(*KEYS, "beta"), least=100))


@register("winsorize_pooled", "SELECT Date, Ticker, round(CASE WHEN pb IS NOT NULL THEN least(greatest(pb, lo), hi) END, 6) AS pb FROM panel, (SELECT quantile_cont(pb, 0.05) AS lo, quantile_cont(pb, 0.95) AS hi FROM panel) q", "panel")
def _(spark, sf_dir):
    return rounded(winsorize_pooled(panel(spark, sf_dir).select(*KEYS, "pb"), 0.05))


def neutral_sql(group: str, size: bool) -> str:
    keep = "market_cap > 0 AND " if size else ""
    return f"""SELECT b.Date, b.Ticker, round(CASE WHEN v AND n > k + CASE WHEN ss > 1e-12 * ll THEN 1 ELSE 0 END THEN yd - CASE WHEN ss > 1e-12 * ll THEN ys / ss ELSE 0 END * sd END, 6) AS beta
      FROM (SELECT Date, Ticker, g, v, y, l, y - AVG(y) OVER (PARTITION BY Date, g) AS yd, l - AVG(l) OVER (PARTITION BY Date, g) AS sd
            FROM (SELECT Date, Ticker, {group} AS g, {keep}{group} IS NOT NULL AND beta IS NOT NULL AS v, CASE WHEN {keep}beta IS NOT NULL THEN beta END AS y, CASE WHEN {keep}beta IS NOT NULL THEN {'ln(market_cap)' if size else '0e0'} END AS l FROM panel) a) b
      JOIN (SELECT Date, SUM(yd * sd) AS ys, SUM(sd * sd) AS ss, SUM(l * l) AS ll, COUNT(CASE WHEN v THEN 1 END) AS n, COUNT(DISTINCT CASE WHEN v THEN g END) AS k
            FROM (SELECT Date, g, v, l, y - AVG(y) OVER (PARTITION BY Date, g) AS yd, l - AVG(l) OVER (PARTITION BY Date, g) AS sd
                  FROM (SELECT Date, {group} AS g, {keep}{group} IS NOT NULL AND beta IS NOT NULL AS v, CASE WHEN {keep}beta IS NOT NULL THEN beta END AS y, CASE WHEN {keep}beta IS NOT NULL THEN {'ln(market_cap)' if size else '0e0'} END AS l FROM panel) a) c GROUP BY Date) s ON b.Date = s.Date"""


def neutral(industry: bool, size: bool):
    def run(spark, sf_dir):
        p = panel(spark, sf_dir)
        return rounded(neutralize(p.select(*KEYS, "beta"), p, neutralize_industry=industry, neutralize_size=size))

    return run


register("neutralize_industry", neutral_sql("gics_sector", False), "panel")(neutral(True, False))
register("neutralize_size", neutral_sql("'all'", True), "panel")(neutral(False, True))
register("neutralize_both", neutral_sql("gics_sector", True), "panel")(neutral(True, True))


@register(
    "orthogonalize_pair",
    """SELECT z.Date, z.Ticker, round(a, 6) AS size, round(CASE WHEN abs(rho) > 0.7 THEN CASE WHEN a IS NOT NULL AND b IS NOT NULL AND n > 2 THEN b - mb - cov / va * (a - ma) END ELSE b END, 6) AS liquidity
    FROM (SELECT Date, Ticker, MAX(CASE WHEN factor = 'size' THEN x END) AS a, MAX(CASE WHEN factor = 'liquidity' THEN x END) AS b FROM zs WHERE factor IN ('size', 'liquidity') GROUP BY Date, Ticker) z
    JOIN (SELECT Date, COUNT(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n, AVG(CASE WHEN b IS NOT NULL THEN a END) AS ma, AVG(CASE WHEN a IS NOT NULL THEN b END) AS mb, covar_pop(a, b) AS cov, var_pop(CASE WHEN b IS NOT NULL THEN a END) AS va,
                 covar_pop(a, b) / NULLIF(stddev_pop(CASE WHEN b IS NOT NULL THEN a END) * stddev_pop(CASE WHEN a IS NOT NULL THEN b END), 0) AS rho
          FROM (SELECT Date, Ticker, MAX(CASE WHEN factor = 'size' THEN x END) AS a, MAX(CASE WHEN factor = 'liquidity' THEN x END) AS b FROM zs WHERE factor IN ('size', 'liquidity') GROUP BY Date, Ticker) y GROUP BY Date) s ON z.Date = s.Date""",
    "zs",
)
def _(spark, sf_dir):
    return rounded(orthogonalize(zscore(raw(spark, sf_dir).select(*KEYS, "size", "liquidity"))))


@register("orthogonalize_full")
def _(spark, sf_dir):
    return rounded(orthogonalize(standardized(spark, sf_dir)))


@register("get_exposures", f"SELECT Date, Ticker, factor, {r6('x')} FROM wz WHERE Date <= DATE '{AS_OF}'", "wz")
def _(spark, sf_dir):
    return longer(get_exposures(panel(spark, sf_dir), FACTORS, as_of=AS_OF))


@register("exposure_stats", "SELECT factor, COUNT(*) - COUNT(x) AS missing, COUNT(x) AS finite, CAST(0 AS BIGINT) AS infinite, round((COUNT(*) - COUNT(x))::DOUBLE / COUNT(*), 6) AS missing_rate FROM long GROUP BY factor", "long")
def _(spark, sf_dir):
    return rounded(exposure_statistics(raw(spark, sf_dir)))


@register("forward_return", "SELECT Date, Ticker, round(y, 6) AS forward_return FROM fwd", "fwd")
def _(spark, sf_dir):
    return rounded(validation.forward_return(panel(spark, sf_dir), 1))


def labelled_exposures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Standardized exposures and the next month's returns, stored, from one panel that is worked out once."""
    p = stored(panel(spark, sf_dir), "panel")
    x = zscore(winsorize(stored(compute_raw_exposures(p, FACTORS), "raw")))
    return stored(rounded(x, 9), "standardized"), stored(validation.forward_return(p, 1), "labels")


def validated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # rounded, so that ties in ranks don't hang on the order in which sums were added up
    x, label = labelled_exposures(spark, sf_dir)
    return validation.validate_factors(x, label, CONFIG)


@register("daily_ic", f"SELECT Date, factor, {r6('ic', 'rank_ic')} FROM daily", "daily")
def _(spark, sf_dir):
    return rounded(validated(spark, sf_dir)["daily"])


@register("factor_summary", f"SELECT factor, n_dates, {r6('mean_ic', 'mean_rank_ic', 'icir', 'rank_icir', 'nw_t', 'coverage', 'mean_spread')}, status FROM summary", "summary")
def _(spark, sf_dir):
    return rounded(validated(spark, sf_dir)["summary"])


@register("newey_west", f"SELECT factor, {r6('nw_t')} FROM nw", "nw")
def _(spark, sf_dir):
    return rounded(validation.newey_west(validated(spark, sf_dir)["daily"], "rank_ic", CONFIG.newey_west_lags))


@register("admission", "SELECT factor, status FROM summary", "summary")
def _(spark, sf_dir):
    return validated(spark, sf_dir)["summary"].select("factor", "status")


@register("coverage", f"SELECT factor, {r6('coverage')} FROM summary", "summary")
def _(spark, sf_dir):
    return rounded(validated(spark, sf_dir)["summary"].select("factor", "coverage"))


@register("quantile_returns", f"SELECT Date, factor, {r6('q1', 'q2', 'q3', 'q4', 'q5', 'spread')} FROM spreads", "spreads")
def _(spark, sf_dir):
    return rounded(validated(spark, sf_dir)["quantiles"])


@register("factor_corr", """SELECT factor_i, factor_j, round(AVG(c), 6) AS correlation FROM (SELECT a.Date, a.factor AS factor_i, b.factor AS factor_j,
    CASE WHEN MIN(a.x) < MAX(a.x) AND MIN(b.x) < MAX(b.x) THEN covar_pop(a.x, b.x) / NULLIF(stddev_pop(a.x) * stddev_pop(b.x), 0) END AS c
    FROM wz a JOIN wz b ON a.Date = b.Date AND a.Ticker = b.Ticker AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2, 3) s GROUP BY 1, 2""", "wz")
def _(spark, sf_dir):
    return rounded(validation.factor_correlations(standardized(spark, sf_dir)))


# ---- risk ---------------------------------------------------------------------------------------------------------


def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zscore(compute_raw_exposures(panel(spark, sf_dir), [FACTORS[1], FACTORS[2]]))
    return z.select(*KEYS, F.col("value").alias("f1"), F.col("earn_yld").alias("f2"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.simple_returns(panel(spark, sf_dir))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.aligned_panel(x2(spark, sf_dir), returns(spark, sf_dir), X2)


def model(spark: SparkSession, sf_dir: str, shrinkage: str = "ledoit-wolf"):
    """x, r, aligned, factor returns, residuals."""
    x, r = stored(x2(spark, sf_dir), "x2"), stored(returns(spark, sf_dir), "returns")
    a = risk.aligned_panel(x, r, X2)
    f = risk.factor_returns(a, X2)
    return x, r, a, f, risk.residual_returns(a, f, X2)


@register("simple_returns", f"SELECT Date, Ticker, {r6('r')} FROM ret", "ret")
def _(spark, sf_dir):
    return rounded(returns(spark, sf_dir))


@register("aligned_panel", f"SELECT Date, Ticker, {r6('f1', 'f2', 'r')} FROM al", "al")
def _(spark, sf_dir):
    return rounded(aligned(spark, sf_dir))


@register("factor_returns_k2", f"SELECT Date, {r6('f1', 'f2')} FROM fr", "fr")
def _(spark, sf_dir):
    return rounded(risk.factor_returns(aligned(spark, sf_dir), X2))


@register("factor_returns_weighted")
def _(spark, sf_dir):
    caps = monthly(spark, sf_dir).select(*KEYS, "market_cap")
    return rounded(risk.factor_returns(aligned(spark, sf_dir).join(caps, list(KEYS)), [*X2, "market_cap"], weights="market_cap"), market_cap=12)


@register("factor_returns_intercept")
def _(spark, sf_dir):
    x = zscore(winsorize(raw(spark, sf_dir).select(*KEYS, *X3)))
    return rounded(risk.factor_returns(risk.aligned_panel(x, portfolio.next_day_return(panel(spark, sf_dir)), X3), X3, intercept=True))


@register("residuals", f"SELECT Date, Ticker, {r6('eps')} FROM eps", "eps")
def _(spark, sf_dir):
    return rounded(model(spark, sf_dir)[4])


def covariance_sql(a: str, b: str, c: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS factor_i, '{j}' AS factor_j, round({v}, 9) AS cov FROM {source}" for i, j, v in (("f1", "f1", a), ("f1", "f2", b), ("f2", "f1", b), ("f2", "f2", c)))


@register("factor_cov_sample", covariance_sql("s11 * n / (n - 1)", "s12 * n / (n - 1)", "s22 * n / (n - 1)", "mom"), "mom")
def _(spark, sf_dir):
    return rounded(risk.factor_covariance(model(spark, sf_dir)[3], shrinkage="sample"), 9)


@register("factor_cov_lw", covariance_sql("c11", "c12", "c22", "f"), "f")
def _(spark, sf_dir):
    return rounded(risk.factor_covariance(model(spark, sf_dir)[3]), 9)


@register("specific_var", "SELECT Ticker, round(specific_var, 8) AS specific_var FROM d", "d")
def _(spark, sf_dir):
    return rounded(risk.specific_variance(model(spark, sf_dir)[4]), 8)


@register("specific_var_diag", "SELECT Ticker, round(0.8 * specific_var + 0.2 * (SELECT AVG(v) FROM (SELECT var_samp(eps) AS v FROM eps GROUP BY Ticker) a), 8) AS specific_var FROM d", "d")
def _(spark, sf_dir):
    return rounded(risk.specific_variance(model(spark, sf_dir)[4], shrinkage="diagonal"), 8)


def estimated(spark: SparkSession, sf_dir: str):
    x, r, _a, f, eps = model(spark, sf_dir)
    return x, r, risk.matrix(risk.factor_covariance(f), X2), risk.specific_variance(eps)


def equal_weights(x_t: DataFrame) -> DataFrame:
    n = x_t.agg(F.count("*").alias("n"))
    return x_t.select("Ticker").join(n, how="cross").select("Ticker", (1 / F.col("n")).alias("weight"))


@register("latest_cross_section", f"SELECT Date, Ticker, {r6('f1', 'f2')} FROM xt", "xt")
def _(spark, sf_dir):
    return rounded(risk.latest_cross_section(x2(spark, sf_dir), AS_OF))


@register("asset_cov_latest", "SELECT a.Ticker AS t1, b.Ticker AS t2, round(a.f1 * b.f1 * c11 + (a.f1 * b.f2 + a.f2 * b.f1) * c12 + a.f2 * b.f2 * c22 + CASE WHEN a.Ticker = b.Ticker THEN COALESCE(specific_var, 0) ELSE 0 END, 8) AS cov FROM xt a CROSS JOIN xt b CROSS JOIN f LEFT JOIN d ON a.Ticker = d.Ticker", "xt", "f", "d")
def _(spark, sf_dir):
    x, _r, f, d = estimated(spark, sf_dir)
    return rounded(risk.asset_covariance(risk.latest_cross_section(x, AS_OF), f, d, X2), 8)


@register("asset_vol", f"SELECT Date, Ticker, {r6('vol')} FROM model", "model")
def _(spark, sf_dir):
    x, _r, f, d = estimated(spark, sf_dir)
    return rounded(risk.asset_volatility(x, f, d, X2, MONTHS))


@register("portfolio_exposure", "SELECT 'f1' AS factor, round(SUM(weight * f1), 6) + 0e0 AS exposure FROM xt JOIN w ON xt.Ticker = w.Ticker UNION ALL SELECT 'f2', round(SUM(weight * f2), 6) + 0e0 FROM xt JOIN w ON xt.Ticker = w.Ticker", "xt", "w")
def _(spark, sf_dir):
    x = risk.latest_cross_section(x2(spark, sf_dir), AS_OF)
    return risk.portfolio_exposure(equal_weights(x), x, X2).select("factor", (F.round("exposure", 6) + 0.0).alias("exposure"))


WEIGHTED = """SELECT xt.*, specific_var, CASE WHEN f1 > 0 THEN 2e0 ELSE 1e0 END / SUM(CASE WHEN f1 > 0 THEN 2e0 ELSE 1e0 END) OVER () AS weight FROM xt LEFT JOIN d ON xt.Ticker = d.Ticker"""


@register("risk_decomposition", f"""SELECT round(fv + sv, 9) AS total_variance, round(fv, 9) AS factor_variance, round(sv, 9) AS specific_variance, round(fv / NULLIF(fv + sv, 0), 6) AS factor_pct, round(sv / NULLIF(fv + sv, 0), 6) AS specific_pct, round(sqrt((fv + sv) * 12), 6) AS volatility
    FROM (SELECT e1 * e1 * c11 + 2 * e1 * e2 * c12 + e2 * e2 * c22 AS fv, sv FROM (SELECT SUM(weight * f1) AS e1, SUM(weight * f2) AS e2, SUM(weight * weight * specific_var) AS sv FROM ({WEIGHTED}) w) e CROSS JOIN f) v""", "xt", "f", "d")
def _(spark, sf_dir):
    x, _r, f, d = estimated(spark, sf_dir)
    x_t = risk.latest_cross_section(x, AS_OF)
    mark = F.when(F.col("f1") > 0, 2.0).otherwise(1.0)
    total = x_t.agg(F.sum(mark).alias("t"))
    w = x_t.join(total, how="cross").select("Ticker", (mark / F.col("t")).alias("weight"))
    return rounded(risk.risk_decomposition(w, x_t, f, d, X2, MONTHS), 9, factor_pct=6, specific_pct=6, volatility=6)


@register("realized_vol", f"SELECT Date, Ticker, {r6('realized_vol')} FROM rv", "rv")
def _(spark, sf_dir):
    return rounded(risk.realized_volatility(returns(spark, sf_dir), 12, MONTHS))


@register("vol_selfcheck", """SELECT m.Date, COUNT(*) AS n_assets, round(AVG(vol), 6) AS model_vol_mean, round(AVG(realized_vol), 6) AS realized_vol_mean, round(AVG(abs(vol - realized_vol)), 6) AS abs_error_mean, round(AVG(abs(vol - realized_vol) / NULLIF(realized_vol, 0)), 6) AS rel_error_mean
    FROM model m JOIN rv ON m.Date = rv.Date AND m.Ticker = rv.Ticker JOIN (SELECT Date, row_number() OVER (ORDER BY Date) AS i FROM (SELECT DISTINCT Date FROM x2) s) n ON m.Date = n.Date WHERE i > 24 GROUP BY m.Date HAVING COUNT(*) >= 10""", "model", "rv")
def _(spark, sf_dir):
    x, r, f, d = estimated(spark, sf_dir)
    return rounded(risk.volatility_selfcheck(x, f, d, r, X2, window=12, min_history=24, annualization=MONTHS))


# ---- portfolios ---------------------------------------------------------------------------------------------------


@register("idio_vol_topk", """SELECT * FROM (SELECT Ticker, round(v, 6) AS idio_vol, 'top' AS side FROM s ORDER BY v DESC, Ticker LIMIT 5) a UNION ALL SELECT * FROM (SELECT Ticker, round(v, 6) AS idio_vol, 'bottom' AS side FROM s ORDER BY v, Ticker LIMIT 5) b""".replace(" FROM s ", " FROM (SELECT Ticker, stddev_samp(eps) * sqrt(12e0) AS v FROM eps GROUP BY Ticker HAVING stddev_samp(eps) IS NOT NULL) s "), "eps")
def _(spark, sf_dir):
    return rounded(portfolio.idiosyncratic_ranking(model(spark, sf_dir)[4], 5, MONTHS))


def _cap_weights(p: DataFrame, ends: Column) -> DataFrame:
    held = p.where(ends)
    return held.join(held.agg(F.sum("market_cap").alias("t")), how="cross").select("Ticker", safe_div(F.col("market_cap"), F.col("t")).alias("weight"))


@register("turnover_cost", """SELECT round(t, 6) AS turnover, round(t * 0.0023, 8) AS cost, round(t * 0.0023 * 12, 8) AS annual_cost FROM (SELECT SUM(abs(COALESCE(b.w, 0) - COALESCE(a.w, 0))) / 2 AS t
    FROM (SELECT Ticker, market_cap / SUM(market_cap) OVER () AS w FROM monthly WHERE Date = DATE '2000-11-01') a FULL JOIN (SELECT Ticker, market_cap / SUM(market_cap) OVER () AS w FROM monthly WHERE Date = DATE '2000-12-01') b ON a.Ticker = b.Ticker) s""", "monthly")
def _(spark, sf_dir):
    p = monthly(spark, sf_dir)
    out = portfolio.turnover_cost(_cap_weights(p, F.col("Date") == F.lit("2000-11-01").cast("date")), _cap_weights(p, F.col("Date") == F.lit("2000-12-01").cast("date")), periods=12)
    return rounded(out, 8, turnover=6)


MARKET = "SELECT Date, AVG(r) / 10 AS ret FROM ret WHERE r IS NOT NULL GROUP BY Date"


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("r is not null").groupBy("Date").agg((F.avg("r") / 10).alias("ret"))


@register("tear_sheet", f"""SELECT round(AVG(ret) * 12, 6) AS annual_return, round(stddev_samp(ret) * sqrt(12e0), 6) AS annual_volatility, round(AVG(ret) * 12 / NULLIF(stddev_samp(ret) * sqrt(12e0), 0), 6) AS sharpe, round(MIN(wealth / peak - 1), 6) AS max_drawdown, round(AVG(ret) * 12 - 0.001 * 12, 6) AS net_return
    FROM (SELECT *, MAX(wealth) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, exp(SUM(ln(1 + ret)) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING)) AS wealth FROM ({MARKET}) m) a) b""", "ret")
def _(spark, sf_dir):
    return rounded(portfolio.tear_sheet(market(spark, sf_dir), periods=12, cost=0.001))


@register("cum_payoff", "SELECT Date, round(exp(SUM(ln(1 + f1)) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING)), 6) AS wealth FROM fr", "fr")
def _(spark, sf_dir):
    f = risk.factor_returns(aligned(spark, sf_dir), X2)
    return rounded(portfolio.compounded(f.select("Date", "f1").where("f1 is not null"), "f1").select("Date", "wealth"))


def _largest(spark: SparkSession, sf_dir: str, n: int = 10) -> list[str]:
    last = risk.latest_cross_section(monthly(spark, sf_dir), AS_OF)
    return [r["Ticker"] for r in last.orderBy(F.desc("market_cap"), "Ticker").limit(n).collect()]


@register("min_variance_weights")
def _(spark, sf_dir):
    names = _largest(spark, sf_dir)
    w = portfolio.min_variance(portfolio.sample_covariance(model(spark, sf_dir)[4], names, MONTHS))
    return spark.createDataFrame([(t, round(float(x), 6)) for t, x in zip(names, w, strict=True)], "Ticker string, weight double")


@register("monte_carlo_var")
def _(spark, sf_dir):
    names = _largest(spark, sf_dir)
    cov = portfolio.sample_covariance(model(spark, sf_dir)[4], names, MONTHS)
    return portfolio.value_at_risk(portfolio.simulate(spark, cov, portfolio.min_variance(cov), days=12, annualization=MONTHS))


@register("describe_columns", """SELECT 'l_orderkey' AS "column", 'bigint' AS inferred_dtype, COUNT(l_orderkey) AS non_null_preview_rows, COUNT(*) - COUNT(l_orderkey) AS null_preview_rows FROM lineitem UNION ALL SELECT 'l_returnflag', 'string', COUNT(l_returnflag), COUNT(*) - COUNT(l_returnflag) FROM lineitem UNION ALL SELECT 'l_discount', 'double', COUNT(l_discount), COUNT(*) - COUNT(l_discount) FROM lineitem""")
def _(spark, sf_dir):
    return describe_columns(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount"))


@register("duplicate_keys", "SELECT CAST(ts AS DATE) AS Date, CAST(user_id AS VARCHAR) AS Ticker, COUNT(*) AS count FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "events").select(F.to_date("ts").alias("Date"), F.col("user_id").cast("string").alias("Ticker")))


@register("min_stock_filter", "SELECT Date, Ticker, round(beta, 6) AS beta FROM (SELECT *, COUNT(*) OVER (PARTITION BY Date) AS n FROM panel WHERE beta IS NOT NULL AND leverage IS NOT NULL) s WHERE n >= 50", "panel")
def _(spark, sf_dir):
    p = panel(spark, sf_dir).select(*KEYS, "beta", "leverage")
    return rounded(portfolio.busy_dates(p, 50).select(*KEYS, "beta"))
