import numpy as np
import pytest
from helpers import day

from quantloom.operators.performance import performance_ratios

SCHEMA = "Date date, Ticker string, r double, n string"


def plain(r, b, periods, target, fraction):
    """Of one series and the benchmark on its dates (NaN where there is none)."""
    wealth = np.cumprod(1 + r)
    worst = (wealth / np.maximum.accumulate(wealth) - 1).min()
    annual = wealth[-1] ** (periods / len(r)) - 1
    down = np.sqrt((np.minimum(r - target, 0) ** 2).mean() * periods)
    gap = (r - b)[np.isfinite(b)]
    error = np.std(gap, ddof=1) * np.sqrt(periods) if len(gap) > 1 else None
    kelly = r.mean() / r.var(ddof=1) if len(r) > 1 else None
    return (
        len(r), annual, down, (r.mean() - target) * periods / down if down else None, worst, annual / -worst if worst else None,
        error, gap.mean() * periods / error if error else None, kelly, None if kelly is None else max(kelly, 0) * fraction,
    )


def test_ratios_of_many_series(spark):
    rng = np.random.default_rng(8)
    series = {f"s{k}": rng.normal(0.01 * (k - 2), 0.05, 40) for k in range(6)} | {"lost": np.array([0.1, -1.0, 0.1]), "one": np.array([0.02]), "up": np.array([0.01, 0.02, 0.03])}
    bench = rng.normal(0.005, 0.03, 40)
    rows = [(day(d), t, float(v), "clash") for t, r in series.items() for d, v in enumerate(r)]
    odd = [(day(50), "s1", None, "x"), (day(51), "s1", float("nan"), "x"), (None, "s1", 9.0, "x"), (day(3), "none", None, "x")]
    order = rng.permutation(len(rows))
    returns = spark.createDataFrame([rows[i] for i in order] + odd, SCHEMA)
    # day 5 has no benchmark, day 6 has it twice
    given = spark.createDataFrame([(day(d), float(v) + e) for d, v in enumerate(bench) if d != 5 for e in ((-0.01, 0.01) if d == 6 else (0.0,))], "Date date, r double")
    bench[5] = np.nan
    got = {r.Ticker: r for r in performance_ratios(returns, given, periods=12, target=0.002, fraction=0.25).collect()}
    assert got.keys() == series.keys()
    for t, r in series.items():
        want = plain(r, bench[: len(r)], 12, 0.002, 0.25)
        assert [v is None for v in got[t][1:]] == [v is None for v in want], t
        assert [v or 0 for v in got[t][1:]] == pytest.approx([v or 0 for v in want], rel=1e-9, abs=1e-12), t
    assert got["lost"].annual_return == -1 and got["lost"].max_drawdown == -1


def test_without_a_benchmark(spark):
    returns = spark.createDataFrame([(day(0), "a", 0.1, ""), (day(1), "a", -2.0, ""), (day(0), None, 0.1, "")], SCHEMA)
    got = {r.Ticker: r for r in performance_ratios(returns).collect()}
    assert got["a"].annual_return is None and got["a"].tracking_error is None and got["a"].information_ratio is None and got["a"].n == 2
    assert got[None].n == 1 and got[None].kelly is None and got[None].held_kelly is None and got[None].calmar is None
    assert performance_ratios(returns.limit(0)).collect() == []
    with pytest.raises(ValueError, match="periods"):
        performance_ratios(returns, periods=0)
    with pytest.raises(ValueError, match="fraction"):
        performance_ratios(returns, fraction=0.0)
