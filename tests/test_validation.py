import numpy as np
import pandas as pd
import pytest
from helpers import day, made, to_pandas, to_spark

from quantloom.operators import validation
from quantloom.operators.validation import ValidationConfig

CONFIG = ValidationConfig(horizon=2, quantiles=4, newey_west_lags=3, min_cross_section=8, min_dates=20, annualization=100)


@pytest.fixture(scope="module")
def signals(spark):
    """`strong` leads the label, `weak` says nothing, `rare` leads it but is seldom there; holes are NaN."""
    rng = np.random.default_rng(77)
    rows, labels = [], []
    for d in range(45):
        for i in range(15):
            y = float(np.round(rng.normal(), 2))
            rows.append((day(d), f"s{i:02d}", float(np.round(y + rng.normal(), 1)), float(np.round(rng.normal(), 1)), y if rng.random() < 0.2 else float("nan")))
            labels.append((day(d), f"s{i:02d}", y if rng.random() < 0.95 else float("nan")))
    names = ("strong", "weak", "rare")
    return to_spark(spark, rows, names), to_spark(spark, labels, ("forward_return",)), to_pandas(rows, names).merge(to_pandas(labels, ("forward_return",)), on=["Date", "Ticker"])


def test_whole_validation_against_pandas(signals):
    x, y, p = signals
    out = validation.validate_factors(x, y, CONFIG)
    daily = {(r.factor, r.Date): r for r in out["daily"].collect()}
    summary = {r.factor: r for r in out["summary"].collect()}
    quantiles = {(r.factor, r.Date): r for r in out["quantiles"].collect()}
    for name in ("strong", "weak", "rare"):
        ranks, spreads = [], []
        for d, g in p.groupby("Date"):
            ok = g[g[name].notna() & g.forward_return.notna()].sort_values("Ticker")
            got = daily[name, d]
            if len(ok) < 8:
                assert got.ic is None and got.rank_ic is None and (name, d) not in quantiles
                continue
            assert got.ic == pytest.approx(ok[name].corr(ok.forward_return)) and got.rank_ic == pytest.approx(ok[name].rank().corr(ok.forward_return.rank()))
            ranks.append(got.rank_ic)
            bucket = pd.qcut(ok[name].rank(method="first"), 4, labels=False)
            means = ok.forward_return.groupby(bucket).mean()
            assert [quantiles[name, d][f"q{k + 1}"] for k in range(4)] == pytest.approx(list(means))
            spreads.append(means[3] - means[0])
        s = summary[name]
        assert s.n_dates == len(ranks) and s.coverage == pytest.approx((p[name].notna() & p.forward_return.notna()).sum() / p.forward_return.notna().sum())
        if len(ranks) > 1:
            e = np.array(ranks) - np.mean(ranks)
            long_run = (e @ e + sum(2 * (1 - k / 4) * (e[k:] @ e[:-k]) for k in range(1, 4) if k < len(e))) / len(e)
            assert s.nw_t == pytest.approx(np.mean(ranks) / np.sqrt(long_run / len(e))) if long_run > 0 else s.nw_t is None
            assert s.mean_spread == pytest.approx(np.mean(spreads)) and s.rank_icir == pytest.approx(np.mean(ranks) / np.std(ranks, ddof=1) * 10)
    assert summary["strong"].status == "accepted" and summary["rare"].status == "rejected"
    pairs = {(r.factor_i, r.factor_j): r.correlation for r in out["correlations"].collect()}
    by_date = p.groupby("Date")[["strong", "weak"]].corr().iloc[0::2, 1]
    assert pairs["strong", "weak"] == pytest.approx(by_date.mean()) and pairs["weak", "strong"] == pairs["strong", "weak"] and pairs["weak", "weak"] == pytest.approx(1)


def test_newey_west_short_series(spark):
    rows = [("one", day(0), 0.4), ("flat", day(0), 0.1), ("flat", day(1), 0.1), ("two", day(0), 0.3), ("two", day(5), None), ("two", day(9), 0.1)]
    got = {r.factor: r.nw_t for r in validation.newey_west(spark.createDataFrame(rows, "factor string, Date date, v double"), "v", 6).collect()}
    long_run = (0.01 + 0.01 + 2 * 0.5 * -0.01) / 2  # two values: one lag, half its weight
    assert got["one"] is None and got["flat"] is None and got["two"] == pytest.approx(0.2 / np.sqrt(long_run / 2))


def test_forward_return_by_position(spark):
    rows = made(41, columns=("px_last",))
    p = to_pandas(rows, ("px_last",))
    want = p.groupby("Ticker").px_last.shift(-3) / p.px_last - 1
    got = {(r.Date, r.Ticker): r.forward_return for r in validation.forward_return(to_spark(spark, rows, ("px_last",)), 3).collect()}
    for d, t, v in zip(p.Date, p.Ticker, want, strict=True):
        assert got[d, t] is None if pd.isna(v) else got[d, t] == pytest.approx(v)
    with pytest.raises(ValueError):
        validation.forward_return(to_spark(spark, rows, ("px_last",)), 0)


def test_statistics_that_are_nan_admit_nothing(spark):
    nan = float("nan")
    rows = [("a", 0.5, nan, 1.0, 99), ("b", nan, 9.0, 1.0, 99), ("c", 0.5, 9.0, nan, 99), ("d", 0.5, 9.0, 1.0, 99)]
    df = spark.createDataFrame(rows, "factor string, mean_rank_ic double, nw_t double, coverage double, n_dates long")
    assert {r.factor: r.status for r in df.select("factor", validation.admission(ValidationConfig()).alias("status")).collect()} == {"a": "candidate", "b": "rejected", "c": "rejected", "d": "accepted"}


@pytest.mark.parametrize("wrong", [{"accepted_ic": -0.1}, {"accepted_t": float("nan")}, {"candidate_ic": float("inf")}, {"accepted_coverage": 1.2}, {"candidate_coverage": True}, {"accepted_ic": "0.1"}, {"horizon": 0}, {"quantiles": 1}, {"newey_west_lags": -1}])
def test_thresholds_are_checked(wrong):
    with pytest.raises(ValueError):
        ValidationConfig(**wrong)
    with pytest.raises(TypeError):
        ValidationConfig(horizon=2.0)


def test_alignment(spark, signals):
    x, y, _ = signals
    validation.check_alignment(x, y)
    more = spark.createDataFrame([(day(400), "s00", 0.1)], y.schema)
    for a, b in ((x, y.where("Ticker <> 's03'")), (x, y.union(more)), (x, y.union(y.limit(1))), (x.union(x.limit(1)), y), (x.limit(0), y.limit(0)), (x, y.withColumn("forward_return", y.forward_return.cast("string")))):
        with pytest.raises(ValueError):
            validation.check_alignment(a, b)
