"""Registered queries of panel assembly, workbooks, joins of tables and the risk run, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.expressions import KEYS
from ..operators import portfolio, risk
from ..operators.factors import compute_raw_exposures
from ..operators.joins import same_keys, unique_dimension
from ..operators.transforms import neutralize, winsorize, zscore
from ..sources import workbook
from ..sources.scratch import join_measured, shared_folder, stored
from ..sources.tables import keyed_mean
from ..sources.workbook_sink import MOST_COLUMNS, write_volumes
from . import assembly
from .panel import monthly, panel, quarterly, table
from .queries import AS_OF, FACTORS, MONTHS, NAMES, ORACLE_SQL, X2, X3, aligned, estimated, r6, register, rounded, sql, x2
from .risk_run import RiskRunConfig, report_summary, run_risk

PANEL = f"SELECT Date, Ticker, round(px_last, 6) AS px_last, round(market_cap, 2) AS market_cap, {r6('pb', 'earn_yld', 'beta')}, round(volume, 2) AS volume, {r6('growth_sales', 'growth_eps', 'leverage')}, gics_sector, gics_industry_group, gics_sub_industry FROM "
DIGITS = {"market_cap": 2, "volume": 2}

# ---- tables of the panel --------------------------------------------------------------------------------------------


def panel_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = monthly(spark, sf_dir)
    return {
        "prices": m.select(*KEYS, "px_last"),
        "daily": m.select(*KEYS, *assembly.DAILY),
        "quarterly": quarterly(spark, sf_dir),
        "industries": m.groupBy("Ticker").agg(*[F.min(c).alias(c) for c in assembly.INDUSTRY]),
    }


@register("price_daily_join", f"SELECT p.Date, p.Ticker, round(px_last, 6) AS px_last, round(d.pb, 6) AS pb FROM monthly p LEFT JOIN (SELECT Date, Ticker, pb FROM monthly WHERE volume > 300) d ON p.Date = d.Date AND p.Ticker = d.Ticker", "monthly")
def _(spark, sf_dir):
    parts = panel_parts(spark, sf_dir)
    return rounded(parts["prices"].join(parts["daily"].where("volume > 300").select(*KEYS, "pb"), list(KEYS), "left"))


@register("quarterly_outer", f"SELECT COALESCE(g.Date, l.Date) AS Date, COALESCE(g.Ticker, l.Ticker) AS Ticker, {r6('growth_sales', 'growth_eps', 'leverage')} FROM (SELECT Date, Ticker, growth_sales, growth_eps FROM quarterly WHERE growth_sales > 0) g FULL JOIN (SELECT Date, Ticker, leverage FROM quarterly WHERE leverage > 0.3) l ON g.Date = l.Date AND g.Ticker = l.Ticker", "quarterly")
def _(spark, sf_dir):
    q = quarterly(spark, sf_dir)
    return rounded(workbook.quarterly_descriptors(q.where("growth_sales > 0").select(*KEYS, "growth_sales", "growth_eps"), q.where("leverage > 0.3").select(*KEYS, "leverage")))


@register("panel_assembly", PANEL + "panel", "panel")
def _(spark, sf_dir):
    return rounded(assembly.build_panel(**panel_parts(spark, sf_dir)), **DIGITS)


def _long(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns as rows (date, ticker, field, value), by their names in the source."""
    names = {n: k for k, n in fields.items()}
    long = df.unpivot(list(KEYS), list(names), "name", "value").where("value is not null")
    return long.select(F.col("Date").alias("date"), F.col("Ticker").alias("ticker"), F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("name")].alias("field"), "value")


@register("panel_from_fields", PANEL + "(SELECT m.*, growth_sales, growth_eps, leverage FROM monthly m LEFT JOIN quarterly q ON m.Date = q.Date AND m.Ticker = q.Ticker) j", "monthly", "quarterly")
def _(spark, sf_dir):
    parts = panel_parts(spark, sf_dir)
    prices = parts["prices"].select(F.col("Date").alias("date"), F.col("Ticker").alias("ticker"), F.col("px_last").alias("close"))
    industries = parts["industries"].select(F.col("Ticker").alias("ticker"), *[F.col(n).alias(k) for k, n in workbook.INDUSTRIES.items()])
    q = {**workbook.GROWTH, **workbook.LEVERAGE}
    return rounded(assembly.panel_from_fields(prices, _long(parts["daily"], workbook.DAILY), _long(parts["quarterly"], q), industries, daily_fields=workbook.DAILY, quarterly_fields=q), **DIGITS)


@register("keyed_mean", "SELECT l_shipdate AS Date, l_suppkey AS Ticker, round(AVG(l_extendedprice), 4) AS tr FROM lineitem GROUP BY 1, 2 HAVING AVG(l_extendedprice) IS NOT NULL")
def _(spark, sf_dir):
    return rounded(keyed_mean(table(spark, sf_dir, "lineitem"), "l_extendedprice", date="l_shipdate", ticker="l_suppkey", name="tr"), 4)


@register("static_join", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return unique_dimension(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nation, "s_nationkey")


@register("same_keys", "SELECT TRUE AS itself, (SELECT COUNT(*) FROM (SELECT Date, Ticker FROM monthly EXCEPT SELECT Date, Ticker FROM quarterly) a) + (SELECT COUNT(*) FROM (SELECT Date, Ticker FROM quarterly EXCEPT SELECT Date, Ticker FROM monthly) b) = 0 AS quarterly", "monthly", "quarterly")
def _(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return spark.createDataFrame([(same_keys(m, panel(spark, sf_dir)), same_keys(m, quarterly(spark, sf_dir)))], "itself boolean, quarterly boolean")


@register("reporting_lag", f"SELECT Date, Ticker, round(LAG(pb, 6) OVER (PARTITION BY Ticker ORDER BY Date), 6) AS pb FROM monthly", "monthly")  # noqa: F541
def _(spark, sf_dir):
    return rounded(portfolio.reported(monthly(spark, sf_dir).select(*KEYS, "pb"), "pb", 6))


# ---- workbooks: the same tables laid out as cells --------------------------------------------------------------------


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's tables as a market workbook lays them out, a block of columns for each ticker, missing values as error texts."""
    m, q = stored(monthly(spark, sf_dir), "monthly"), stored(quarterly(spark, sf_dir), "quarterly")
    industries = m.groupBy("Ticker").agg(*[F.min(c).alias(c) for c in assembly.INDUSTRY])
    named = stored(industries.withColumn("position", F.row_number().over(Window.orderBy("Ticker")) - 1), "industries")  # one row a ticker
    order = named.select("Ticker", "position")
    serial = F.datediff("Date", F.lit(workbook.EPOCHS[False]).cast("date")).cast("string")

    def placed(df: DataFrame) -> DataFrame:
        return stored(join_measured(df.withColumn("row", F.row_number().over(Window.partitionBy("Ticker").orderBy("Date")) + 1), order, ["Ticker"], "inner"), "placed")

    def grid(rows: DataFrame, sheet: str, width: int, first: int, fields) -> DataFrame:
        values = F.array(serial, *[F.coalesce(F.col(c).cast("string"), F.lit("#N/A N/A")) for c in fields])
        return rows.select(F.lit(sheet).alias("sheet"), "row", "position", F.posexplode(values).alias("at", "value")).select("sheet", "row", (F.col("position") * width + F.col("at") + first + 1).alias("col"), "value")

    def heads(sheet: str, titles) -> DataFrame:
        title = F.array(*[F.col("Ticker") if t is None else F.lit(t) for t in titles])
        return order.select(F.lit(sheet).alias("sheet"), F.lit(1).alias("row"), "position", F.posexplode(title).alias("at", "value")).select("sheet", "row", (F.col("position") * len(titles) + F.col("at") + 1).alias("col"), "value")

    days, quarters = placed(m), placed(q)
    small = [("Config", 1, 1, "source"), ("Config", 1, 2, "made"), ("Universe", 1, 1, "ticker"), ("Meta", 1, 1, "n_securities"), *[("Industries", 1, i + 1, t) for i, t in enumerate(("ticker", *workbook.INDUSTRIES))]]
    titles = (None, *workbook.DAILY, None, *workbook.GROWTH, None, *workbook.LEVERAGE)
    n = len(titles)
    sheets = [
        spark.createDataFrame(small, workbook.CELLS), order.agg(F.lit("Meta").alias("sheet"), F.lit(1).alias("row"), F.lit(2).alias("col"), F.count("*").cast("string").alias("value")),
        order.selectExpr("'Universe' sheet", "position + 2 row", "1 col", "Ticker value"), named.select(F.lit("Industries").alias("sheet"), (F.col("position") + 2).alias("row"), F.posexplode(F.array("Ticker", *assembly.INDUSTRY)).alias("at", "value")).selectExpr("sheet", "row", "at + 1 col", "value"),
        heads("Prices", ("", None)), grid(days, "Prices", 2, 0, ["px_last"]), heads("Descriptors_TS", titles), grid(days, "Descriptors_TS", n, 0, workbook.DAILY.values()),
        grid(quarters, "Descriptors_TS", n, 6, workbook.GROWTH.values()), grid(quarters, "Descriptors_TS", n, 9, workbook.LEVERAGE.values()),
    ]
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s)
    return stored(out.where("value <> ''"), "cells")


def _workbook(name: str, text: str, *parts: str):
    def wrap(f):
        def run(spark, sf_dir):
            cells = workbook_cells(spark, sf_dir)
            return rounded(f(cells, workbook.universe(cells)), **DIGITS)

        return register(name, text, *parts)(run)

    return wrap


@_workbook("workbook_universe", "SELECT row_number() OVER (ORDER BY Ticker) - 1 AS position, Ticker FROM (SELECT DISTINCT Ticker FROM monthly) s", "monthly")
def _(cells, tickers):
    return tickers


@_workbook("workbook_prices", f"SELECT Date, Ticker, {r6('px_last')} FROM monthly", "monthly")
def _(cells, tickers):
    return workbook.prices(cells, tickers)


@_workbook("workbook_daily", f"SELECT Date, Ticker, round(market_cap, 2) AS market_cap, {r6('pb', 'earn_yld', 'beta')}, round(volume, 2) AS volume FROM monthly", "monthly")
def _(cells, tickers):
    return workbook.descriptors(cells, tickers)[0]


@_workbook("workbook_quarterly", f"SELECT Date, Ticker, {r6('growth_sales', 'growth_eps', 'leverage')} FROM quarterly", "quarterly")
def _(cells, tickers):
    return workbook.descriptors(cells, tickers)[1]


@_workbook("workbook_industries", "SELECT DISTINCT Ticker, gics_sector, gics_industry_group, gics_sub_industry FROM monthly", "monthly")
def _(cells, tickers):
    return workbook.industries(cells, tickers)


@_workbook("workbook_diagnostics", "SELECT Ticker, field, COUNT(*) AS n FROM (SELECT Ticker, unnest(['SALES_GROWTH', 'EPS_GROWTH', 'TOT_DEBT_TO_COM_EQY']) AS field, unnest([growth_sales, growth_eps, leverage]) AS v FROM quarterly) s WHERE v IS NULL GROUP BY 1, 2", "quarterly")
def _(cells, tickers):
    return workbook.diagnostics(cells, tickers).groupBy("Ticker", "field").agg(F.count("*").alias("n"))


@register("workbook_panel", PANEL + "panel", "panel")
def _(spark, sf_dir):
    return rounded(assembly.workbook_panel(workbook_cells(spark, sf_dir)), **DIGITS)


# ---- transforms and risk with more factors ---------------------------------------------------------------------------

_SECTOR = "SELECT l.*, gics_sector AS g, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS s FROM long l JOIN panel p ON l.Date = p.Date AND l.Ticker = p.Ticker"


@register("neutralize_all", f"""SELECT Date, Ticker, factor, round(CASE WHEN n > k + CASE WHEN ss > 1e-12 * ll THEN 1 ELSE 0 END THEN yd - CASE WHEN ss > 1e-12 * ll THEN ys / ss ELSE 0 END * sd END, 6) AS x
    FROM (SELECT *, SUM(yd * sd) OVER d AS ys, SUM(sd * sd) OVER d AS ss, SUM(CASE WHEN x IS NOT NULL THEN s * s END) OVER d AS ll, COUNT(x) OVER d AS n, k FROM
          (SELECT *, x - AVG(x) OVER gd AS yd, CASE WHEN x IS NOT NULL THEN s - AVG(CASE WHEN x IS NOT NULL THEN s END) OVER gd END AS sd FROM ({_SECTOR}) a WINDOW gd AS (PARTITION BY Date, factor, g)) b
          JOIN (SELECT Date AS kd, factor AS kf, COUNT(DISTINCT CASE WHEN x IS NOT NULL THEN g END) AS k FROM ({_SECTOR}) c GROUP BY 1, 2) c ON kd = Date AND kf = factor WINDOW d AS (PARTITION BY Date, factor)) e""", "long", "panel")
def _(spark, sf_dir):
    p = stored(panel(spark, sf_dir), "panel")
    x = neutralize(stored(compute_raw_exposures(p, FACTORS), "raw"), p)
    return rounded(x.unpivot(list(KEYS), NAMES, "factor", "x"))


def _solve3(a: str) -> str:
    """Three unknowns by determinants; a names the sums' subquery with columns s11 .. s33 and b1 .. b3."""
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    full = [[s(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    out = []
    for c in range(3):
        m = [[f"b{i + 1}" if j == c else full[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{det(m)} / NULLIF({det(full)}, 0) AS beta{c + 1}")
    return f"SELECT *, {', '.join(out)} FROM ({a}) sums"


def _sums(w: str, x: list[str], r: str) -> str:
    cells = [f"SUM({w} * {x[i]} * {x[j]}) AS s{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)] + [f"SUM({w} * {x[i]} * {r}) AS b{i + 1}" for i in range(3)]
    return ", ".join(cells)


_X3 = ", ".join(f"MAX(CASE WHEN factor = '{n}' THEN x END) AS {n}" for n in X3)
_NEXT = "SELECT Date, Ticker, LEAD(px_last) OVER (PARTITION BY Ticker ORDER BY Date) / NULLIF(px_last, 0) - 1 AS r FROM panel"
_ALIGNED = f"SELECT x.*, r FROM (SELECT Date, Ticker, {_X3} FROM wz GROUP BY 1, 2) x JOIN ({_NEXT}) n ON x.Date = n.Date AND x.Ticker = n.Ticker WHERE {' AND '.join(f'{n} IS NOT NULL' for n in X3)} AND r IS NOT NULL"
_CENTRED = "SELECT Date, r, " + ", ".join(f"{n}, {n} - AVG({n}) OVER (PARTITION BY Date) AS d{i + 1}" for i, n in enumerate(X3)) + f" FROM ({_ALIGNED}) a"
_MEANS = ", ".join(f"AVG({n}) AS m{i + 1}" for i, n in enumerate(X3))


@register("factor_returns_k3", "SELECT Date, " + ", ".join(f"round(beta{i + 1}, 6) AS {n}" for i, n in enumerate(X3)) + f" FROM ({_solve3('SELECT Date, COUNT(*) AS n, ' + _sums('1', X3, 'r') + f' FROM ({_ALIGNED}) a GROUP BY Date')}) s WHERE n >= 4", "wz", "panel")
def _(spark, sf_dir):
    x = zscore(winsorize(compute_raw_exposures(panel(spark, sf_dir), FACTORS).select(*KEYS, *X3)))
    f = risk.factor_returns(risk.aligned_panel(x, portfolio.next_day_return(panel(spark, sf_dir)), X3), X3)
    return rounded(f.dropna("all", subset=X3))


@register("factor_returns_intercept_k3", "SELECT Date, round(mr - beta1 * m1 - beta2 * m2 - beta3 * m3, 6) AS const, " + ", ".join(f"round(beta{i + 1}, 6) AS {n}" for i, n in enumerate(X3)) + f" FROM ({_solve3('SELECT Date, COUNT(*) AS n, AVG(r) AS mr, ' + _MEANS + ', ' + _sums('1', ['d1', 'd2', 'd3'], 'r') + f' FROM ({_CENTRED}) a GROUP BY Date')}) s WHERE n >= 5", "wz", "panel")
def _(spark, sf_dir):
    x = zscore(winsorize(compute_raw_exposures(panel(spark, sf_dir), FACTORS).select(*KEYS, *X3)))
    f = risk.factor_returns(risk.aligned_panel(x, portfolio.next_day_return(panel(spark, sf_dir)), X3), X3, intercept=True)
    return rounded(f.dropna("all", subset=X3))


@register("factor_returns_caps", f"""SELECT Date, round((b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), 6) AS f1, round((b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12), 6) AS f2
    FROM (SELECT al.Date, SUM(w * f1 * f1) AS a11, SUM(w * f1 * f2) AS a12, SUM(w * f2 * f2) AS a22, SUM(w * f1 * r) AS b1, SUM(w * f2 * r) AS b2, COUNT(*) AS n FROM al JOIN (SELECT Date, Ticker, market_cap AS w FROM monthly) m ON al.Date = m.Date AND al.Ticker = m.Ticker GROUP BY al.Date) s WHERE n >= 3""", "al", "monthly")
def _(spark, sf_dir):
    caps = monthly(spark, sf_dir).select(*KEYS, "market_cap")
    return rounded(risk.factor_returns(aligned(spark, sf_dir).join(caps, list(KEYS)), X2, weights="market_cap").dropna("all", subset=X2))


# the same model with a row for each date, NULL where it can't be solved
ORACLE_SQL["factor_returns_intercept"] = sql("SELECT Date, " + ", ".join(f"CASE WHEN n >= 5 THEN round({v}, 6) END AS {n}" for n, v in [("const", "mr - beta1 * m1 - beta2 * m2 - beta3 * m3"), *[(x, f"beta{i + 1}") for i, x in enumerate(X3)]]) + f" FROM ({_solve3('SELECT Date, COUNT(*) AS n, AVG(r) AS mr, ' + _MEANS + ', ' + _sums('1', ['d1', 'd2', 'd3'], 'r') + f' FROM ({_CENTRED}) a GROUP BY Date')}) s", "wz", "panel")


# weighted, with the capitalization as a column as well: its unit (here 1e6) is taken off before the sums are solved
ORACLE_SQL["factor_returns_weighted"] = sql("SELECT Date, CASE WHEN n >= 4 THEN round(beta1, 6) END AS f1, CASE WHEN n >= 4 THEN round(beta2, 6) END AS f2, CASE WHEN n >= 4 THEN round(beta3 / 1e6, 12) END AS market_cap FROM ("
    + _solve3("SELECT Date, COUNT(*) AS n, " + _sums("w", ["f1", "f2", "c"], "r") + " FROM (SELECT al.*, market_cap AS w, market_cap / 1e6 AS c FROM al JOIN (SELECT Date, Ticker, market_cap FROM monthly) m ON al.Date = m.Date AND al.Ticker = m.Ticker) a GROUP BY Date") + ") s", "al", "monthly")


def risk_run(spark: SparkSession, sf_dir: str):
    """The whole risk model with all ten factors that a month has enough rows for."""
    p = stored(panel(spark, sf_dir), "panel")
    x = zscore(winsorize(stored(compute_raw_exposures(p, FACTORS), "raw")))
    return run_risk(x, risk.simple_returns(p), RiskRunConfig(window=12, min_history=24, annualization=MONTHS))


@register("risk_run_k10")
def _(spark, sf_dir):
    return rounded(risk_run(spark, sf_dir).tables["factor_cov"], 9)


_REPORT = ("model_vol_mean", "realized_vol_mean", "abs_error_mean", "rel_error_mean")


@register("risk_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median FROM ({ORACLE_SQL['vol_selfcheck']}) s{i}" for i, c in enumerate(_REPORT)))
def _(spark, sf_dir):
    x, r, f, d = estimated(spark, sf_dir)
    return rounded(report_summary(rounded(risk.volatility_selfcheck(x, f, d, r, X2, window=12, min_history=24, annualization=MONTHS))))


_HELD = "(SELECT Ticker, row_number() OVER (ORDER BY Ticker) * 1e0 / (SELECT SUM(i) FROM (SELECT row_number() OVER (ORDER BY Ticker) AS i FROM xt) s) AS weight FROM xt)"


def _unequal(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    x = risk.latest_cross_section(x2(spark, sf_dir), AS_OF)
    i = x.select("Ticker", F.row_number().over(Window.orderBy("Ticker")).alias("i"))  # one row a ticker of one date
    return x, i.select("Ticker", (F.col("i") / F.sum("i").over(Window.partitionBy())).alias("weight"))


@register("held_weights", f"SELECT Ticker, round(weight, 6) AS weight FROM {_HELD} h WHERE weight > 0.001", "xt")
def _(spark, sf_dir):
    return rounded(portfolio.held_weights(_unequal(spark, sf_dir)[1], 0.001))


@register("renormalized_exposure", f"SELECT 'f1' AS factor, round(SUM(weight * f1) / SUM(weight), 6) + 0e0 AS exposure FROM (SELECT * FROM xt WHERE f1 > -0.5) x JOIN {_HELD} h ON x.Ticker = h.Ticker UNION ALL SELECT 'f2', round(SUM(weight * f2) / SUM(weight), 6) + 0e0 FROM (SELECT * FROM xt WHERE f1 > -0.5) x JOIN {_HELD} h ON x.Ticker = h.Ticker", "xt")
def _(spark, sf_dir):
    x, weights = _unequal(spark, sf_dir)
    x = x.where("f1 > -0.5")
    return risk.portfolio_exposure(portfolio.renormalized(weights, x), x, X2).select("factor", (F.round("exposure", 6) + 0.0).alias("exposure"))


@register("workbook_file", PANEL.replace("round(px_last, 6)", "round(px_last, 9)") + "panel", "panel")
def _(spark, sf_dir):
    """The panel's tables written as workbook files in the shared folder, a volume for as many tickers as the format has
    columns for, and the panel read from those files."""
    volumes = workbook.split_volumes(workbook_cells(spark, sf_dir), MOST_COLUMNS // workbook.WIDTH)
    paths = write_volumes(volumes, f"{shared_folder(spark)}/quantloom-books/{uuid.uuid4().hex}")
    cells = workbook.join_volumes(stored(workbook.read_volumes(spark, paths), "volumes"))
    return rounded(assembly.workbook_panel(stored(cells, "cells")), px_last=9, **DIGITS)
