"""Many trials and pairs: against normal tables, numpy and plain versions."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from quantloom.operators import multiplicity, pairs

NORMAL = NormalDist()


def test_normal_expressions(spark):
    x = [-8.0, -3.1, -1.0, -0.2, 0.0, 0.7, 2.5, 6.0]
    p = [1e-9, 0.01, 0.024, 0.03, 0.5, 0.8, 0.98, 1 - 1e-9]
    got = spark.createDataFrame(list(zip(x, p, strict=True)), "x double, p double").select("x", "p", F.expr(multiplicity.normal_cdf("x")).alias("c"), F.expr(multiplicity.normal_quantile("p")).alias("q")).collect()
    for r in got:
        assert r.c == pytest.approx(NORMAL.cdf(r.x), abs=1e-7) and r.q == pytest.approx(NORMAL.inv_cdf(r.p), rel=1e-8, abs=1e-8)


def test_deflated_sharpe(spark):
    rng = np.random.default_rng(17)
    common = rng.normal(size=80)
    series = {f"s{i}": 0.02 * i + (0.8 * common + 0.6 * rng.normal(size=80)) * 0.1 for i in range(4)} | {"lone": rng.normal(0.01, 0.1, 80), "flat": np.full(80, 0.01)}
    rows = [(day(d), n, float(v[d])) for n, v in series.items() for d in range(80)] + [(day(3), None, 1.0), (day(90), "lone", None)]
    got = {r.trial: r for r in multiplicity.deflated_sharpe(spark.createDataFrame(rows, "Date date, trial string, ret double")).collect()}
    del series["flat"]
    assert set(got) == set(series)
    c = np.corrcoef(list(series.values()))
    spectrum = np.linalg.eigvalsh(c)
    n = spectrum.sum() ** 2 / (spectrum**2).sum()
    sharpe = {k: v.mean() / v.std(ddof=1) for k, v in series.items()}
    bar = np.std(list(sharpe.values()), ddof=1) * ((1 - 0.5772156649) * NORMAL.inv_cdf(1 - 1 / n) + 0.5772156649 * NORMAL.inv_cdf(1 - 1 / (n * math.e)))
    for k, v in series.items():
        e = v - v.mean()
        skew, kurt = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2
        want = NORMAL.cdf((sharpe[k] - bar) * math.sqrt(79) / math.sqrt(1 - skew * sharpe[k] + (kurt - 1) / 4 * sharpe[k] ** 2))
        assert (got[k].trials, got[k].bar, got[k].sharpe) == pytest.approx((n, bar, sharpe[k])) and got[k].deflated == pytest.approx(want, abs=1e-6)
    one = multiplicity.deflated_sharpe(spark.createDataFrame([r for r in rows if r[1] == "lone"], "Date date, trial string, ret double")).first()
    assert one.trials == 1 and one.bar == 0


def test_false_discoveries(spark):
    t = {"a": 4.0, "b": -2.9, "c": 2.4, "d": 2.1, "e": 0.3, "f": -2.1, "g": None}
    got = {r.factor: r for r in multiplicity.false_discoveries(spark.createDataFrame(list(t.items()), "factor string, nw_t double"), rate=0.05).collect()}
    p = {k: 2 * (1 - NORMAL.cdf(abs(v))) for k, v in t.items() if v is not None}
    order = sorted(p, key=lambda k: (p[k], k))
    for i, k in enumerate(order):
        want = min(min(p[j] * len(p) / (m + 1) for m, j in enumerate(order) if m >= i), 1)
        assert got[k].adjusted == pytest.approx(want, abs=1e-6) and got[k].discovery == (want <= 0.05)
    assert set(got) == set(p)


@pytest.fixture(scope="module")
def market(spark):
    """Random walks by sector; b follows a, and d follows c, with errors that die out."""
    rng = np.random.default_rng(23)
    days = 160
    walks = {f"w{i:02d}": np.cumsum(rng.normal(scale=0.05, size=days)) for i in range(20)}
    error = np.zeros(days)
    for d in range(1, days):
        error[d] = 0.4 * error[d - 1] + rng.normal(scale=0.02)
    walks["pa"] = np.cumsum(rng.normal(scale=0.05, size=days))
    walks["pb"] = 0.3 + 1.5 * walks["pa"] + error
    rows = [(day(d), n, "s1" if n in ("pa", "pb") or int(n[1:]) < 10 else "s2", None if (d, n) == (5, "w03") else float(np.exp(v[d]))) for n, v in walks.items() for d in range(days)]
    rows += [(day(d), "still", "s1", 2.0) for d in range(days)] + [(day(0), "short", "s2", 1.0), (day(1), "short", "s2", 1.5), (day(2), "neg", "s2", -1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame([(r[0], r[1], r[2], None if r[3] is None else float(r[3])) for r in rows], "Date date, Ticker string, gics_sector string, px_last double"), walks


def plain_test(x, y, lags):
    slope, constant = np.polyfit(x, y, 1)
    z = y - slope * x - constant
    d = np.diff(z)
    target = d[lags:]
    design = np.array([[z[t], *[d[t - j] for j in range(1, lags + 1)]] for t in range(lags, len(d))])
    beta = np.linalg.solve(design.T @ design, design.T @ target)
    left = target - design @ beta
    covariance = left @ left / (len(target) - lags - 1) * np.linalg.inv(design.T @ design)
    return slope, constant, beta[0] / np.sqrt(covariance[0, 0])


@pytest.mark.parametrize("lags", [1, 2])
def test_pairs_against_plain_version(spark, market, lags):
    df, walks = market
    prices = pairs.log_prices(df)
    got = {(r.a, r.b): r for r in pairs.cointegrated_pairs(prices, lags=lags).collect()}
    candidates = {(r.a, r.b): r.group for r in pairs.candidate_pairs(prices).collect()}
    assert ("pa", "pb") in got and got["pa", "pb"].cointegrated and not any("still" in k for k in candidates)
    assert len(candidates) <= 16 * 3 * 24 and all(df.where(F.col("Ticker").isin(a, b)).select("gics_sector").distinct().count() == 1 for a, b in list(candidates)[:5])
    for (a, b), r in got.items():
        assert candidates[a, b] == r.group
        if "w03" in (a, b):
            keep = np.arange(160) != 5
        else:
            keep = np.ones(160, bool)
        slope, constant, t = plain_test(walks[a][keep], walks[b][keep], lags)
        assert r.n == keep.sum() and (r.slope, r.constant) == pytest.approx((slope, constant)) and r.adf_t == pytest.approx(t, rel=1e-6)
    assert set(got) == {k for k in candidates if "short" not in k}


def test_pairs_grow_with_instruments_not_with_their_square(spark):
    rng = np.random.default_rng(1)
    rows = [(day(d), f"x{i}", "one", float(v)) for i in range(120) for d, v in enumerate(np.cumsum(rng.normal(size=12)))]
    n = pairs.candidate_pairs(spark.createDataFrame(rows, "Date date, Ticker string, group string, y double"), sketches=4, neighbours=2).count()
    assert 120 < n <= 120 * 8
    assert pairs.cointegrated_pairs(spark.createDataFrame([], "Date date, Ticker string, group string, y double")).collect() == []


def test_pairs_are_tested_without_a_group_each(spark, market):
    """Two rows a pair meet in a join; a pair is no group of its rows, nor is it joined by its dates."""
    plan = pairs.cointegrated_pairs(pairs.log_prices(market[0]))._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    kept = market[0].where("Ticker <> 'pb' or Date not in (date'2019-03-10', date'2019-03-20')")
    got = {(r.a, r.b): r.n for r in pairs.cointegrated_pairs(pairs.log_prices(kept)).collect()}
    assert got["pa", "pb"] == 158
