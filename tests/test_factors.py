import numpy as np
import pytest
from helpers import day, made, same, to_pandas, to_spark

from quantloom.operators.factors import SIZE, VALUE, Factor, Liquidity, Momentum, Volatility, check_factors, compute_raw_exposures
from quantloom.operators.joins import asof_backward, same_keys, unique_dimension
from quantloom.operators.portfolio import reported

COLUMNS = ("px_last", "volume", "market_cap", "pb")


@pytest.mark.parametrize("nan", [False, True])
def test_formulas_against_pandas(spark, nan):
    """Prices, volumes and ratios with holes (NULL or NaN) and values that aren't positive."""
    rows = made(1, days=40, columns=COLUMNS, nan=nan)
    p = to_pandas(rows, COLUMNS)
    x = compute_raw_exposures(to_spark(spark, rows, COLUMNS), [SIZE, VALUE, Momentum(lookback_days=7, skip_days=2), Volatility(window_days=4, annualization=50), Liquidity(window_days=3)])
    by = p.assign(price=p.px_last.where(p.px_last > 0), v=p.volume.where(p.volume > 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        p["size"], p["value"] = np.log(p.market_cap.where(p.market_cap > 0)), -np.log(p.pb.where(p.pb > 0))
        price = by.groupby("Ticker").price
        p["momentum"] = price.shift(2) / price.shift(7) - 1
        by["ret"] = by.price / price.shift(1) - 1
        p["volatility"] = by.groupby("Ticker").ret.transform(lambda s: s.rolling(4).std(ddof=0)) * np.sqrt(50)
        p["liquidity"] = np.log(by.groupby("Ticker").v.transform(lambda s: s.rolling(3).mean()))
    same(x, p, ["size", "value", "momentum", "volatility", "liquidity"])


def test_later_rows_change_nothing(spark):
    rows = made(2, days=25, columns=COLUMNS)
    factors = [Momentum(lookback_days=6, skip_days=1), Volatility(window_days=5), Liquidity(window_days=5)]
    whole = {(r.Date, r.Ticker): r for r in compute_raw_exposures(to_spark(spark, rows, COLUMNS), factors).collect()}
    part = compute_raw_exposures(to_spark(spark, [r for r in rows if r[0] <= day(15)], COLUMNS), factors).collect()
    assert all(whole[r.Date, r.Ticker] == r for r in part)


def test_parameters_and_lists_are_checked():
    for make in (lambda: Momentum(lookback_days=4, skip_days=4), lambda: Momentum(lookback_days=4, skip_days=-1), lambda: Volatility(window_days=1), lambda: Volatility(annualization=0)):
        with pytest.raises(ValueError):
            make()
    have = ["Date", "Ticker", "market_cap"]
    check_factors([SIZE], have)
    for wrong, error in (([], ValueError), (["size"], TypeError), ([Factor("\t", ("market_cap",))], ValueError), ([SIZE, SIZE], ValueError), ([VALUE], ValueError)):
        with pytest.raises(error):
            check_factors(wrong, have)


def test_asof_takes_the_latest_row_as_a_whole(spark):
    left, right = made(3, days=30, columns=("p",), holes=0), made(4, days=30, names=9, columns=("g", "h"), holes=0.4)[:60]
    got = {(r.Date, r.Ticker): (r.p, r.g, r.h) for r in asof_backward(to_spark(spark, left, ("p",)), to_spark(spark, right, ("g", "h"))).collect()}
    assert len(got) == len(left)
    for d, t, p in left:
        before = [r for r in right if r[1] == t and r[0] <= d]
        want = max(before)[2:] if before else (None, None)
        assert got[d, t] == (p, *want)


def test_key_checks_and_dimension_joins(spark):
    facts = spark.createDataFrame([(day(0), "k1", 1.0), (day(1), "k1", 2.0), (day(1), "q2", 3.0)], "Date date, Ticker string, v double")
    dimension = spark.createDataFrame([("k1", "one"), ("zz", "none")], "Ticker string, name string")
    assert sorted((r.v, r.name) for r in unique_dimension(facts, dimension).collect()) == [(1.0, "one"), (2.0, "one"), (3.0, None)]
    with pytest.raises(ValueError):
        unique_dimension(facts, dimension.union(dimension))
    assert same_keys(facts, facts.drop("v")) and not same_keys(facts, facts.where("v < 3")) and not same_keys(facts.where("v < 3"), facts)


def test_reporting_lag(spark):
    rows = made(5, columns=("pe",))
    want = to_pandas(rows, ("pe",))
    want["pe"] = want.groupby("Ticker").pe.shift(4)
    same(reported(to_spark(spark, rows, ("pe",)), "pe", 4), want, ["pe"])
