import json

import numpy as np
import pandas as pd
import pytest
from helpers import day, made, to_pandas, to_spark

from quantloom.operators import portfolio, risk
from quantloom.plans import risk_run as rr
from quantloom.plans.risk_run import RiskRunConfig, report_summary, run_risk

K = 10
NAMES = [f"x{k}" for k in range(K)]


@pytest.fixture(scope="module")
def market(spark):
    """Sixty days of thirty instruments with ten factors; some exposures are NaN and some returns missing."""
    rng = np.random.default_rng(9)
    rows, paid = [], rng.normal(scale=0.02, size=(60, K))
    for d in range(60):
        x = rng.normal(size=(30, K))
        r = x @ paid[d] + 0.01 * rng.normal(size=30)
        x[rng.random(x.shape) < 0.002] = np.nan
        rows += [(day(d), f"m{i:02d}", *map(float, x[i]), None if rng.random() < 0.02 else float(r[i])) for i in range(30)]
    df = to_spark(spark, rows, [*NAMES, "r"]).cache()
    return df.select("Date", "Ticker", *NAMES), df.select("Date", "Ticker", "r"), to_pandas(rows, [*NAMES, "r"])


@pytest.fixture(scope="module")
def plain(market):
    """The model by numpy: factor returns by date, residuals, covariance, specific variances."""
    p = market[2].dropna()
    f, eps = {}, []
    for d, g in p.groupby("Date"):
        f[d] = np.linalg.pinv(g[NAMES].to_numpy()) @ g.r.to_numpy()
        eps.append(g[["Date", "Ticker"]].assign(eps=g.r - g[NAMES].to_numpy() @ f[d]))
    eps = pd.concat(eps)
    c = np.array(list(f.values()))
    c = c - c.mean(axis=0)
    n = len(c)
    s = c.T @ c / n
    mu = np.trace(s) / K
    far = ((s - mu * np.eye(K)) ** 2).sum()
    noise = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / n**2, far)
    return f, eps, s * n / (n - 1), s + noise / far * (mu * np.eye(K) - s), eps.groupby("Ticker").eps.var()


def test_factor_returns_and_residuals(spark, market, plain):
    a = risk.aligned_panel(market[0], market[1], NAMES)
    f = risk.factor_returns(a, NAMES)
    got = {r.Date: [r[n] for n in NAMES] for r in f.collect()}
    assert set(got) == set(plain[0]) and all(got[d] == pytest.approx(list(v), abs=1e-9) for d, v in plain[0].items())
    eps = {(r.Date, r.Ticker): r.eps for r in risk.residual_returns(a, f, NAMES).collect()}
    assert len(eps) == len(plain[1]) and all(eps[r.Date, r.Ticker] == pytest.approx(r.eps, abs=1e-9) for r in plain[1].itertuples())
    few = risk.factor_returns(a.where("Ticker < 'm10'"), NAMES)
    assert few.where("x0 is not null").count() == 0  # ten rows, ten factors
    with_constant = risk.factor_returns(a.where(a.Date == day(3)), NAMES[:2], intercept=True).first()
    g = market[2].dropna().query("Date == @day(3)")
    want = np.linalg.lstsq(np.column_stack([np.ones(len(g)), g[NAMES[:2]]]), g.r, rcond=None)[0]
    assert [with_constant.const, with_constant.x0, with_constant.x1] == pytest.approx(list(want))


def test_whole_run_against_numpy(spark, market, plain, tmp_path):
    f, _, sample, shrunk, specific = plain
    run = run_risk(market[0], market[1], RiskRunConfig(window=10, min_history=20, label="test"), output_dir=str(tmp_path / "out"))
    got = risk.matrix(run.tables["factor_cov"], NAMES)
    assert got == pytest.approx(shrunk, abs=1e-12)
    assert risk.matrix(risk.factor_covariance(run.tables["factor_returns"], shrinkage="sample"), NAMES) == pytest.approx(sample, abs=1e-12)
    assert {r.Ticker: r.specific_var for r in run.tables["specific_variance"].collect()} == pytest.approx(specific.to_dict())
    p = market[2].dropna()
    last = p[p.Date == p.Date.max()].sort_values("Ticker")
    sigma = last[NAMES].to_numpy() @ shrunk @ last[NAMES].to_numpy().T + np.diag(specific[last.Ticker])
    wide = run.tables["asset_covariance_latest"].toPandas().pivot(index="t1", columns="t2", values="cov").to_numpy()
    assert wide == pytest.approx(sigma)
    m = run.manifest
    w = np.full(len(last), 1 / len(last))
    assert m["equal_weight_decomposition"]["total_variance"] == pytest.approx(w @ sigma @ w) and m["equal_weight_decomposition"]["factor_pct"] + m["equal_weight_decomposition"]["specific_pct"] == pytest.approx(1)
    assert m["checks"]["Sigma_min_eigenvalue"] == pytest.approx(np.linalg.eigvalsh(sigma)[0]) and m["checks"]["F_positive_definite"] and m["checks"]["Sigma_positive_definite"]
    assert m["shapes"]["X_complete_rows"] == len(p) and m["shapes"]["Sigma"] == [len(last)] * 2 and m["selfcheck"]["effective_dates"] == 40
    # what was written reads back as what was given
    out = tmp_path / "out"
    stored = json.loads((out / "run_manifest.json").read_text())
    assert stored == m and stored["label"] == "test"
    assert spark.read.parquet(str(out / "factor_cov.parquet")).count() == K * K and spark.read.parquet(str(out / "idio_returns.parquet")).count() == len(p)
    report = spark.read.csv(str(out / "selfcheck_report.csv"), header=True, inferSchema=True)
    assert report.count() == 40 and {r["column"]: r["median"] for r in report_summary(report).collect()}["rel_error_mean"] == pytest.approx(m["selfcheck"]["rel_error_median"])
    with pytest.raises(FileExistsError):
        run_risk(market[0], market[1], RiskRunConfig(window=10, min_history=20), output_dir=str(out))
    with pytest.raises(ValueError):
        run_risk(market[0], market[1], RiskRunConfig(window=10, min_history=20, most_assets=5))


def test_wrong_arguments(market):
    f = risk.factor_returns(risk.aligned_panel(market[0], market[1], NAMES), NAMES)
    for call in (lambda: risk.factor_covariance(f, shrinkage="other"), lambda: risk.specific_variance(market[1], shrinkage="other"), lambda: risk.latest_cross_section(market[0], "1990-01-01"), lambda: RiskRunConfig(window=0), lambda: portfolio.min_variance(np.eye(4), 0.2)):
        with pytest.raises(ValueError):
            call()


def test_stored_exposures_and_names(spark, market, tmp_path):
    from quantloom.sources.files import write_json

    market[0].write.parquet(str(tmp_path / "x.parquet"))
    write_json(spark, f"{tmp_path}/meta.json", {"factors": [{"name": "b"}, {"name": "a"}]})
    got = rr.load_exposures(spark, str(tmp_path / "x.parquet"))
    keys = [(r.Date, r.Ticker) for r in got.select("Date", "Ticker").collect()]
    assert keys == sorted(keys) and rr.load_factor_names(spark, f"{tmp_path}/meta.json") == ["b", "a"]
    for load in (rr.load_exposures, rr.load_factor_names):
        with pytest.raises(FileNotFoundError):
            load(spark, str(tmp_path / "absent"))


def test_realized_volatility_and_portfolio_exposure(spark, market):
    p = market[2]
    want = p.groupby("Ticker").r.transform(lambda s: s.rolling(8, min_periods=4).std()) * np.sqrt(252)
    got = {(r.Date, r.Ticker): r.realized_vol for r in risk.realized_volatility(market[1], 8).collect()}
    assert all(got[d, t] is None if pd.isna(v) else got[d, t] == pytest.approx(v) for d, t, v in zip(p.Date, p.Ticker, want, strict=True))
    x = market[0].where(market[0].Date == day(5)).dropna()
    weights = spark.createDataFrame([(f"m{i:02d}", float(i)) for i in range(30)], "Ticker string, weight double")
    some = x.where("Ticker < 'm09'")
    local = some.toPandas()
    w = local.Ticker.str[1:].astype(float)
    scaled = portfolio.renormalized(weights, some)
    assert {r.factor: r.exposure for r in risk.portfolio_exposure(scaled, some, ["x0", "x1"]).collect()} == pytest.approx({n: (w / w.sum()) @ local[n] for n in ("x0", "x1")})
    assert {r.exposure for r in risk.portfolio_exposure(weights.where("weight > 3"), some, ["x0"]).collect()} == {None}
    assert portfolio.held_weights(weights, 27.5).count() == 2
    paid = {r.factor: r.contribution for r in risk.factor_attribution(some, scaled, {"x0": 0.5, "x1": -2.0}).collect()}
    assert paid == pytest.approx({"x0": 0.5 * (w / w.sum()) @ local.x0, "x1": -2 * (w / w.sum()) @ local.x1})


def test_least_variance_conditions():
    """The gradient is level where weights are free, higher at 0 and lower at the cap."""
    rng = np.random.default_rng(14)
    root = rng.normal(size=(12, 40))
    cov = root @ root.T
    w = portfolio.min_variance(cov, 0.15, least=0)
    g = cov @ w
    free = (w > 1e-7) & (w < 0.15 - 1e-7)
    assert w.sum() == pytest.approx(1) and free.any() and np.ptp(g[free]) < 1e-5 * abs(g).max()
    assert (g[w <= 1e-7] > g[free].min() - 1e-5).all() and (g[w >= 0.15 - 1e-7] < g[free].max() + 1e-5).all()


def test_simulated_tail_against_its_moments(spark):
    """Sums of many small normal returns: the tail of the lognormal that has the same moments."""
    cov, w, days = np.array([[0.03, -0.01], [-0.01, 0.05]]), np.array([0.3, 0.7]), 30
    sims = portfolio.simulate(spark, cov, w, simulations=20_000, days=days).cache()
    got = portfolio.value_at_risk(sims).first()
    variance = w @ cov @ w / 252
    assert got.simulations == 20_000 and sims.select("sim").distinct().count() == 20_000
    assert got["var"] == pytest.approx(np.exp(-days * variance / 2 - 2.3263 * np.sqrt(days * variance)) - 1, abs=0.006)
    again = portfolio.simulate(spark, cov, w, simulations=20_000, days=days)
    assert portfolio.value_at_risk(again).first()["var"] == got["var"]


def test_turnover_and_tear_sheet(spark):
    a, b = (spark.createDataFrame(list(x.items()), "Ticker string, weight double") for x in ({"p": 0.25, "q": 0.75}, {"q": 0.5, "s": 0.5}))
    t = portfolio.turnover_cost(a, b, rate=0.01, periods=12).first()
    assert (t.turnover, t.cost, t.annual_cost) == pytest.approx((0.5, 0.005, 0.06))
    r = [0.03, -0.05, 0.0, 0.02, -0.04, 0.06]
    s = portfolio.tear_sheet(spark.createDataFrame([(day(i), v) for i, v in enumerate(r)], "Date date, ret double"), periods=10, cost=0.001).first()
    wealth = np.cumprod(1 + np.array(r))
    assert s.annual_return == pytest.approx(10 * np.mean(r)) and s.annual_volatility == pytest.approx(np.std(r, ddof=1) * np.sqrt(10)) and s.max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min()) and s.net_return == pytest.approx(10 * np.mean(r) - 0.012)


def test_busy_dates(spark):
    rows = made(51, days=12, names=8, columns=("a", "b"), holes=0.2)
    p = to_pandas(rows, ("a", "b")).dropna()
    n = p.groupby("Date").a.transform("size")
    assert {(r.Date, r.Ticker) for r in portfolio.busy_dates(to_spark(spark, rows, ("a", "b")), 5).collect()} == set(zip(p.Date[n >= 5], p.Ticker[n >= 5], strict=True))


def test_columns_of_very_different_units(spark):
    """Weighted regressions with the weight itself as a column a thousand million times the others; and dependent columns,
    for which the solution of least norm is meant."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for d in range(6):
        n = 40
        x = rng.normal(size=(n, 3))
        x[:, 2] = x[:, 0] - 2 * x[:, 1] if d % 2 else x[:, 2]
        caps = np.exp(rng.normal(size=n)) * 1e9
        caps[0] = -5.0  # counts as no weight
        r = x[:, 0] * 0.3 - x[:, 1] + caps * 2e-10 + rng.normal(scale=0.01, size=n)
        a, w = np.column_stack([x, caps]), np.sqrt(np.clip(caps, 0, None))
        scale = np.linalg.norm(a * w[:, None], axis=0)  # in the units given, lstsq itself would lose nine digits
        want[day(d)] = np.linalg.lstsq(a * w[:, None] / scale, r * w, rcond=1e-9)[0] / scale
        if d % 2:  # the null space of the unscaled columns taken off
            null = np.array([1.0, -2.0, -1.0, 0.0]) / np.sqrt(6)
            want[day(d)] -= null * (null @ want[day(d)])
        rows += [(day(d), f"s{i}", *map(float, x[i]), float(caps[i]), float(r[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, a double, b double, c double, market_cap double, r double")
    names = ["a", "b", "c", "market_cap"]
    for f in risk.factor_returns(df, names, weights="market_cap").collect():
        assert [f[n] for n in names[:3]] == pytest.approx(want[f.Date][:3].tolist(), rel=1e-6, abs=1e-8) and f.market_cap == pytest.approx(want[f.Date][3], rel=1e-6)


def test_many_assets_as_one_matrix(spark):
    """More assets than one matrix on the driver was once meant for: every pair, and the smallest eigenvalue without the matrix."""
    rng = np.random.default_rng(31)
    n = 2_100
    e, d = rng.normal(size=(n, 2)), rng.uniform(0.01, 0.5, n)
    f = np.array([[0.04, 0.01], [0.01, 0.02]])
    x = spark.createDataFrame([(day(0), f"m{i:04d}", *map(float, e[i])) for i in range(n)], "Date date, Ticker string, a double, b double")
    own = spark.createDataFrame([(f"m{i:04d}", float(d[i])) for i in range(n)], "Ticker string, specific_var double")
    got = risk.asset_covariance(x, f, own, ["a", "b"])
    assert got.count() == n * n and got.rdd.getNumPartitions() > 1
    want = e @ f @ e.T + np.diag(d)
    for r in got.where("t1 in ('m0003', 'm2099') and t2 in ('m0003', 'm1500')").collect():
        assert r["cov"] == pytest.approx(want[int(r.t1[1:]), int(r.t2[1:])])


@pytest.mark.parametrize("n, f, equal", [(60, [[0.04, 0.01], [0.01, 0.02]], False), (60, [[0.04, 0.02], [0.02, 0.01]], False), (2, [[0.04, 0.01], [0.01, 0.02]], False), (40, [[0.04, 0.0], [0.0, -0.3]], False), (50, [[0.04, 0.01], [0.01, 0.02]], True), (30, [[0.0, 0.0], [0.0, 0.0]], False)])
def test_smallest_eigenvalue_without_the_matrix(spark, n, f, equal):
    rng = np.random.default_rng(n)
    f, e, d = np.array(f), rng.normal(size=(n, 2)), np.full(n, 0.3) if equal else rng.uniform(0.01, 0.5, n)
    held = spark.createDataFrame([(float(d[i]), *map(float, e[i])) for i in range(n)], "specific_var double, a double, b double")
    assert risk.smallest_asset_eigenvalue(held, f, ["a", "b"]) == pytest.approx(np.linalg.eigvalsh(e @ f @ e.T + np.diag(d))[0], rel=1e-9)


def test_a_file_of_the_asset_covariance_has_few_tickers(spark, tmp_path, monkeypatch):
    """Tiles: no task writes all columns of the matrix, so that names stay in a file's dictionary however many there are."""
    monkeypatch.setattr(risk, "BLOCK", 50)
    monkeypatch.setattr(risk, "PAIRS_A_TASK", 2_000)
    rng = np.random.default_rng(37)
    e, d = np.repeat(rng.normal(size=(40, 2)), 5, axis=0), rng.uniform(0.01, 0.5, 200)
    f = np.array([[0.04, 0.01], [0.01, 0.02]])
    x = spark.createDataFrame([(day(0), f"m{i:04d}", *map(float, e[i])) for i in range(200)], "Date date, Ticker string, a double, b double")
    own = spark.createDataFrame([(f"m{i:04d}", float(d[i])) for i in range(1, 200)], "Ticker string, specific_var double")
    d[0] = 0.0  # the one without a variance
    risk.asset_covariance(x, f, own, ["a", "b"]).write.parquet(f"{tmp_path}/cov")
    got = spark.read.parquet(f"{tmp_path}/cov").selectExpr("*", "input_file_name() file").toPandas()
    assert len(got) == 200 * 200 and got.groupby("file").t2.nunique().max() < 150 and got.file.nunique() > 10
    want = e @ f @ e.T + np.diag(d)
    assert got.pivot(index="t1", columns="t2", values="cov").to_numpy() == pytest.approx(want)
