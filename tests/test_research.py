"""Statistical factors, Fama-MacBeth, exponential weights, block bootstrap, tails: against numpy and plain loops."""

import hashlib
import math

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from quantloom.operators import decay, premia, resampling, statistical, tails, validation


def to_rows(dense, names, holes=()):
    return [(day(d), n, None if (d, i) in holes else float(dense[d, i])) for d in range(len(dense)) for i, n in enumerate(names)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(31)
    days, n = 50, 14
    dense = 0.01 + rng.normal(scale=[0.2, 0.1, 0.05], size=(days, 3)) @ rng.normal(size=(3, n)) + rng.normal(scale=0.02, size=(days, n))
    holes = {(int(rng.integers(days)), int(rng.integers(n))) for _ in range(25)}
    rows = to_rows(dense, [f"t{i:02d}" for i in range(n)], holes)
    rows[5] = (*rows[5][:2], float("nan"))
    for d, i in {*holes, (0, 5)}:
        dense[d, i] = np.nan
    rng.shuffle(rows)
    return spark.createDataFrame([(r[0], r[1], None if r[2] is None else float(r[2])) for r in rows], "Date date, Ticker string, r double").cache(), dense


@pytest.mark.parametrize("correlation", [False, True])
def test_components_against_numpy(spark, panel, correlation):
    df, dense = panel
    out = statistical.statistical_factors(df, 3, correlation=correlation)
    x = dense - np.nanmean(dense, axis=0)
    if correlation:
        x = x / np.nanstd(dense, axis=0)
    x = np.nan_to_num(x)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    spectrum = out.spectrum.orderBy("factor").collect()
    assert [r.variance for r in spectrum] == pytest.approx((s[:3] ** 2 / (len(x) - 1)).tolist()) and [r.share for r in spectrum] == pytest.approx((s[:3] ** 2 / (x**2).sum()).tolist())
    got = np.zeros((3, x.shape[1]))
    for r in out.loadings.collect():
        got[r.factor - 1, int(r.Ticker[1:])] = r.loading
    assert np.linalg.svd(got @ v[:3].T)[1].min() > 1 - 1e-9  # the angle between the spaces
    for k in range(3):
        sign = np.sign(v[k] @ got[k])
        assert got[k] == pytest.approx(sign * v[k], abs=1e-6) and got[k][np.abs(got[k]).argmax()] > 0
    score = {(r.Date, r.factor): r.score for r in out.scores.collect()}
    assert all(score[day(d), k + 1] == pytest.approx(x[d] @ got[k], abs=1e-6) for d in range(len(x)) for k in range(3))


def test_few_components_and_none(spark, panel):
    df = spark.createDataFrame([(day(d), f"t{i}", float((d - 2) * (i + 1))) for d in range(5) for i in range(3)], "Date date, Ticker string, r double")
    out = statistical.statistical_factors(df, 4)
    assert [r.share for r in out.spectrum.orderBy("factor").collect()] == pytest.approx([1, 0, 0, 0], abs=1e-9) and {r.factor for r in out.loadings.collect()} == {1}
    for wrong in (df.limit(0), df.where("Ticker = 'none'"), df.withColumn("r", F.lit(1.0))):
        with pytest.raises(ValueError):
            statistical.statistical_factors(wrong, 2)
    with pytest.raises(ValueError):
        statistical.statistical_factors(df, 2, most_dates=3)


@pytest.mark.parametrize("k, least", [(1, 12), (3, 9)])
def test_fama_macbeth_against_numpy(spark, panel, k, least):
    df, dense = panel
    rng = np.random.default_rng(2)
    f = rng.normal(scale=0.1, size=(50, k)) + np.nanmean(dense, axis=1, keepdims=True)
    f[7, 0] = np.nan
    names = [f"f{i}" for i in range(k)]
    factors = spark.createDataFrame([(day(d), *map(float, f[d])) for d in range(50)], "Date date, " + ", ".join(f"{n} double" for n in names))
    out = premia.fama_macbeth(df, factors, names, window=12, least=least, lags=3)
    betas = {(r.Date, r.Ticker): [r[n] for n in names] for r in out["betas"].collect()}
    want = np.full((50, 14, k), np.nan)
    for i in range(14):
        for d in range(50):
            past = [t for t in range(max(0, d - 12), d) if np.isfinite(dense[t, i]) and np.isfinite(f[t]).all()]
            if len(past) >= least:
                want[d, i] = np.linalg.lstsq(np.column_stack([np.ones(len(past)), f[past]]), dense[past, i], rcond=None)[0][1:]
            b = betas[day(d), f"t{i:02d}"]
            assert b == [None] * k if np.isnan(want[d, i, 0]) else b == pytest.approx(want[d, i].tolist(), abs=1e-8)
    series = {n: [] for n in ("const", *names)}
    got = {r.Date: r for r in out["premia"].collect()}
    for d in range(50):
        ok = np.isfinite(want[d, :, 0]) & np.isfinite(dense[d])
        if ok.sum() >= k + 2:
            gamma = np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), want[d, ok]]), dense[d, ok], rcond=None)[0]
            for n, g in zip(series, gamma, strict=True):
                assert got[day(d)][n] == pytest.approx(g, abs=1e-7)
                series[n].append(g)
    for r in out["summary"].collect():
        v = np.array(series[r.factor])
        e = v - v.mean()
        lrv = (e @ e + 2 * sum((1 - j / 4) * (e[j:] @ e[:-j]) for j in (1, 2, 3))) / len(v)
        assert (r.n_dates, r.premium) == (len(v), pytest.approx(v.mean(), abs=1e-8)) and r.nw_t == pytest.approx(v.mean() / math.sqrt(lrv / len(v)), abs=1e-6)
    with pytest.raises(ValueError):
        premia.rolling_betas(df, factors, names, window=k + 1)


def recursion(v, lam):
    s, out = 0.0, []
    for x in v:
        s = lam * s + (1 - lam) * x
        out.append(s)
    return out


@pytest.mark.parametrize("lam, n", [(0.94, 300), (0.6, 150), (0.99, 10)])
def test_exponential_weights_are_the_recursion(spark, lam, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    df = spark.createDataFrame([(day(d), *map(float, x[d])) for d in rng.permutation(n)], "Date date, a double, b double, c double")
    got = {(r.factor_i, r.factor_j): r["cov"] for r in decay.ewma_covariance(df, ["a", "b", "c"], lam).collect()}
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            assert got[p, q] == pytest.approx(recursion(x[:, i] * x[:, j], lam)[-1])
    scaled = {(r.factor_i, r.factor_j): r["cov"] for r in decay.ewma_covariance(df, ["a", "b", "c"], lam, normalize=True).collect()}
    assert scaled["a", "b"] == pytest.approx(got["a", "b"] / (1 - lam**n))
    long = df.unpivot(["Date"], ["a", "b", "c"], "Ticker", "r").where("not (Ticker = 'b' and Date = date'2019-03-09')")
    path = {(r.Ticker, r.Date): r.e for r in decay.exponential_mean(long, F.col("r"), lam, name="e").collect()}
    want = recursion(x[:, 0], lam)
    assert all(path["a", day(d)] == pytest.approx(want[d]) for d in range(n))
    vol = {(r.Ticker, r.Date): r.vol for r in decay.ewma_volatility(long, lam, annualization=100).collect()}
    want = recursion(np.delete(x[:, 1], 5) ** 2, lam)
    assert vol["b", day(n - 1)] == pytest.approx(10 * want[-1] ** 0.5) and vol["b", day(4)] == pytest.approx(10 * want[4] ** 0.5) and ("b", day(5)) not in vol


def test_states_of_any_parts_merge(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=400)
    placed = spark.createDataFrame([(int(i), float(v[i]), int(rng.integers(3))) for i in range(400)], "place long, v double, part int")
    parts = [decay.ewma_states(placed.where(F.col("part") == p), [F.col("v")], 0.9) for p in (2, 0, 1)]
    merged = decay.merge_states(parts[0].union(parts[1]).union(parts[2]), 399, 1, 0.9).first()["sums"][0]
    assert merged == pytest.approx(recursion(v, 0.9)[-1])
    for wrong in (0, 1, -0.5):
        with pytest.raises(ValueError):
            decay.ewma_states(placed, [F.col("v")], wrong)


def test_bootstrap_against_plain_version(spark):
    rng = np.random.default_rng(13)
    x = {n: rng.normal(m, 1, 47) for n, m in (("up", 0.5), ("flat", 0.0))}
    x["flat"][3:9] = np.nan
    rows = [(n, day(d), None if np.isnan(v[d]) else float(v[d])) for n, v in x.items() for d in range(47)]
    df = spark.createDataFrame(rows, "factor string, Date date, ic double")
    got = {r.factor: r for r in resampling.block_bootstrap(df, "ic", block=5, replicates=200, level=0.9, seed=7).collect()}
    assert got == {r.factor: r for r in resampling.block_bootstrap(df.repartition(7), "ic", block=5, replicates=200, level=0.9, seed=7).collect()} or all(abs(got[r.factor].low - r.low) < 1e-12 for r in resampling.block_bootstrap(df.repartition(7), "ic", block=5, replicates=200, level=0.9, seed=7).collect())
    limits = resampling.poisson_limits()
    for n, v in x.items():
        means = []
        for r in range(1, 201):
            num = den = 0.0
            for b in range(10):
                u = int(hashlib.md5(f"7:{r}:{b}".encode()).hexdigest()[:8], 16)
                w = sum(u >= c for c in limits)
                own = v[5 * b : 5 * b + 5]
                num, den = num + w * np.nansum(own), den + w * np.isfinite(own).sum()
            means.append(num / den)
        assert got[n].n == np.isfinite(v).sum() and got[n]["mean"] == pytest.approx(np.nanmean(v)) and got[n].error == pytest.approx(np.std(means, ddof=1))
        assert (got[n].low, got[n].high) == pytest.approx(tuple(np.quantile(means, [0.05, 0.95])))
    # counts of a Poisson draw
    w = np.searchsorted(limits, rng.integers(0, 2**32, 100_000), side="right")
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize("few, parts", [(10_000, 4096), (3, 5), (1, 2)])
def test_selection(spark, monkeypatch, few, parts):
    monkeypatch.setattr(tails, "FEW", few)
    monkeypatch.setattr(tails, "PARTS", parts)
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(size=257), "ties": np.round(rng.normal(size=257), 1), "wild": np.sign(rng.normal(size=257)) * np.exp(rng.normal(size=257) * 9), "one": np.full(257, 2.5)}
    rows = [tuple(float(c[i]) for c in columns.values()) for i in range(257)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + "").withColumn("none", F.lit(None).cast("double"))
    levels = [0.0, 0.01, 0.37, 0.5, 1.0]
    got = tails.exact_quantiles(df, [*columns, "none"], levels)
    assert got["none"] == [None] * 5
    for c, v in columns.items():
        assert got[c] == pytest.approx(np.quantile(v, levels).tolist(), rel=1e-9)


def test_huge_range(spark):
    v = [-1.7e308, 1.7e308, 0.0, 1e-300, 5.0]
    df = spark.createDataFrame([(x,) for x in v * 3000], "v double")
    assert tails.exact_quantiles(df, ["v"], [0.0, 0.3, 0.5, 0.7, 1.0])["v"] == [-1.7e308, 0.0, 1e-300, 5.0, 1.7e308]


def test_tail_risk(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_t(4, 400) * 0.02
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "r double, still double")
    got = {r.name: r for r in tails.tail_risk(df, ["r", "still"], 0.05).collect()}
    q = np.quantile(x, 0.05)
    e = x - x.mean()
    skew, kurt, z = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2 - 3, -1.6448536269514722
    cf = z + (z * z - 1) / 6 * skew + (z**3 - 3 * z) / 24 * kurt - (2 * z**3 - 5 * z) / 36 * skew**2
    r = got["r"]
    assert (r.n, r.value_at_risk, r.tail_expectation) == (400, pytest.approx(-q), pytest.approx(-x[x <= q].mean()))
    assert (r.skewness, r.excess_kurtosis) == pytest.approx((skew, kurt)) and r.modified_var == pytest.approx(-(x.mean() + x.std(ddof=1) * cf)) and r.normal_var == pytest.approx(-(x.mean() + x.std(ddof=1) * z))
    assert got["still"].modified_var is None and got["still"].value_at_risk == -1
    assert validation.average_ranks(np.array([3.0, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
