import numpy as np
import pandas as pd
import pytest
from helpers import day, made, same, to_pandas, to_spark

from quantloom.operators.transforms import factor_columns, neutralize, orthogonalize, winsorize, winsorize_pooled, zscore

AB = ("a", "b")


@pytest.fixture(scope="module", params=[False, True], ids=["null", "nan"])
def panel(request, spark):
    """Holes as NULL and as NaN, a constant date and one with a single value."""
    rows = made(11, nan=request.param) + [(day(90), f"c{i}", 7.5, float(i)) for i in range(4)] + [(day(91), "c1", 2.0, None)]
    return to_spark(spark, rows, AB), to_pandas(rows, AB)


def test_winsorize(panel):
    x, p = panel
    want = p.copy()
    for c in AB:
        by = p.groupby("Date")[c]
        want[c] = p[c].clip(by.transform(lambda s: s.quantile(0.15)), by.transform(lambda s: s.quantile(0.8)))
    same(winsorize(x, lower_quantile=0.15, upper_quantile=0.8), want, AB)


@pytest.mark.parametrize("ddof", [0, 1])
def test_zscore(panel, ddof):
    x, p = panel
    want = p.copy()
    for c in AB:
        by = p.groupby("Date")[c]
        spread = by.transform(lambda s: s.std(ddof=ddof) if s.nunique() > 1 else np.nan)
        want[c] = (p[c] - by.transform("mean")) / spread
    same(zscore(x, ddof=ddof), want, AB)


def test_least_values_of_a_date(panel):
    x, p = panel
    got = {r.Date for r in zscore(x, least=10).where("a is not null").collect()}
    assert got == {d for d, s in p.groupby("Date").a if s.count() >= 10}


def test_pooled_winsorize(panel):
    x, p = panel
    want = p.copy()
    for c in AB:
        want[c] = p[c].clip(p[c].quantile(0.1), p[c].quantile(0.9))
    same(winsorize_pooled(x, 0.1), want, AB)


def test_wrong_arguments(spark, panel):
    x = panel[0]
    for call, error in ((lambda: winsorize(x, lower_quantile=False), TypeError), (lambda: winsorize(x, lower_quantile=0.6, upper_quantile=0.6), ValueError), (lambda: zscore(x, ddof=0.5), TypeError), (lambda: zscore(x, ddof=-2), ValueError), (lambda: winsorize_pooled(x, 0.5), ValueError), (lambda: orthogonalize(x, correlation_threshold=1.5), ValueError)):
        with pytest.raises(error):
            call()
    for bad in (x.drop("Date"), x.select("Date", "Ticker"), x.withColumn("a", x.a.cast("string")), x.withColumn("Date", x.Date.cast("string"))):
        with pytest.raises(ValueError):
            factor_columns(bad)
    assert factor_columns(x, unique=True) == ["a", "b"]
    with pytest.raises(ValueError):
        factor_columns(x.union(x.limit(1)), unique=True)


@pytest.mark.parametrize("industry, size", [(True, True), (True, False), (False, True)])
def test_neutralize_leaves_least_squares_residuals(spark, industry, size):
    rng = np.random.default_rng(21)
    rows = []
    for d in range(3):
        for i in range(25):
            cap = None if i == 4 else -1.0 if i == 9 else float(rng.lognormal(2, 1))
            rows.append((day(d), f"n{i:02d}", None if i == 6 else float(rng.normal()), float(rng.normal()), cap, None if i == 13 else ("steel", "food", "rail")[i * 7 % 3]))
    x = spark.createDataFrame(rows, "Date date, Ticker string, a double, b double, market_cap double, gics_sector string")
    p = pd.DataFrame(rows, columns=["Date", "Ticker", "a", "b", "cap", "sector"])
    p["log"] = [np.log(v) if v is not None and v > 0 else np.nan for v in p.cap]
    want = p[["Date", "Ticker"]].copy()
    for c in AB:
        want[c] = np.nan
        for _, g in p.groupby("Date"):
            ok = g[c].notna() & (g.log.notna() | (not size)) & (g.sector.notna() | (not industry))
            own = g[ok]
            parts = [np.ones((len(own), 1))] + [pd.get_dummies(own.sector, drop_first=True).to_numpy(float)] * industry + [own[["log"]].to_numpy()] * size
            design, y = np.hstack(parts), own[c].astype(float).to_numpy()
            want.loc[own.index, c] = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    same(neutralize(x.select("Date", "Ticker", *AB), x, neutralize_industry=industry, neutralize_size=size), want, AB)


def test_neutralize_without_degrees_of_freedom(spark):
    x = spark.createDataFrame([(day(0), "u", 4.0, 2.0, "steel"), (day(0), "v", 9.0, 3.0, "food")], "Date date, Ticker string, a double, market_cap double, gics_sector string")
    assert [r.a for r in neutralize(x.select("Date", "Ticker", "a"), x).collect()] == [None, None]
    with pytest.raises(ValueError):
        neutralize(x.select("Date", "Ticker", "a"), x.drop("market_cap"))


def test_orthogonalize_by_a_plain_loop(spark):
    """Of four factors the second follows the first, the fourth the third; with holes."""
    rng = np.random.default_rng(31)
    rows = []
    for d in range(4):
        for i in range(18):
            u, v = rng.normal(size=2)
            rows.append((day(d), f"o{i}", float(u), None if i == d else float(u + 0.2 * rng.normal()), float(v), float(-v + 0.3 * rng.normal() + 0.01 * u)))
    names = ("f", "g", "h", "k")
    want = pd.DataFrame(rows, columns=["Date", "Ticker", *names]).astype({n: float for n in names})
    for _, g in want.groupby("Date"):
        own = g[list(names)].copy()
        for j in range(1, 4):
            chosen = [names[i] for i in range(j) if abs(own[names[i]].corr(own[names[j]])) > 0.7]
            if chosen:
                ok = own[[*chosen, names[j]]].notna().all(axis=1)
                design = np.column_stack([np.ones(ok.sum()), own.loc[ok, chosen]])
                y = own.loc[ok, names[j]]
                own[names[j]] = pd.Series(y - design @ np.linalg.pinv(design) @ y, index=y.index).reindex(own.index)
        want.loc[g.index, list(names)] = own
    same(orthogonalize(to_spark(spark, rows, names)), want, names, 1e-8)


def test_panel_is_not_shuffled_by_date(spark, tmp_path):
    """Statistics of few groups are sent to the rows: no exchange stands above the scan of the panel in what a step returns."""
    rows = made(19, days=12, names=9, columns=("a", "cap"), holes=0.0)
    to_spark(spark, rows, ("a", "cap")).selectExpr("*", "case when Ticker < 'q' then 'x' else 'y' end gics_sector", "abs(cap) + 1 market_cap").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    x = p.select("Date", "Ticker", "a")
    for out, joins in ((winsorize(x), 1), (zscore(x), 1), (zscore(winsorize(x)), 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == joins and "Exchange hashpartitioning" not in plan and plan.count("Scan parquet") == joins + 1
    plan = neutralize(x, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 4  # both inputs once, and two tables of statistics


def test_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    from quantloom.sources import scratch

    monkeypatch.setattr(scratch, "BROADCAST_NUMBERS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = made(19, days=12, names=9, columns=("a",))
        x = to_spark(spark, rows, ("a",))
        out = zscore(x)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        p = to_pandas(rows, ("a",))
        by = p.groupby("Date").a
        p["a"] = (p.a - by.transform("mean")) / by.transform(lambda s: s.std(ddof=0) if s.nunique() > 1 else np.nan)
        same(out, p, ("a",))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tables_go(spark):
    from quantloom.sources import scratch

    t = scratch.stored(spark.range(5), "five")
    assert t.count() == 5
    scratch.drop_stored(spark)
    with pytest.raises(Exception):  # noqa: B017  its files are gone
        t.count()
    assert scratch.stored(spark.range(3), "three").count() == 3
