import datetime as dt
import json
import math

import numpy as np
import pytest
from helpers import day, to_pandas

from quantloom.operators import validation
from quantloom.operators.factors import SIZE, VALUE
from quantloom.plans import pipeline as pl

END = day(9).isoformat()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(61)
    rows = [(day(d), f"p{i}", float(rng.lognormal(3, 1)) if i != d else 0.0, float("nan") if i == 3 else float(rng.lognormal()), ("steel", "food")[i % 2]) for d in range(12) for i in range(9)]
    return spark.createDataFrame(rows, "Date date, Ticker string, market_cap double, pb double, gics_sector string")


def test_exposures_by_pandas(spark, panel):
    rows = [(r.Date, r.Ticker, r.market_cap) for r in panel.where(panel.Date <= END).collect()]
    p = to_pandas(rows, ("cap",))
    p["size"] = np.log(p.cap.where(p.cap > 0))
    by = p.groupby("Date")["size"]
    w = p["size"].clip(by.transform(lambda s: s.quantile(0.01)), by.transform(lambda s: s.quantile(0.99)))
    by = w.groupby(p.Date)
    want = dict(zip(zip(p.Date, p.Ticker, strict=True), (w - by.transform("mean")) / by.transform(lambda s: s.std(ddof=0)), strict=True))
    got = pl.get_exposures(panel, [SIZE], as_of=END).collect()
    assert [(r.Date, r.Ticker) for r in got] == sorted(want)
    for r in got:
        assert r.size is None if math.isnan(want[r.Date, r.Ticker]) else r.size == pytest.approx(want[r.Date, r.Ticker])


@pytest.mark.parametrize("switches", [{}, {"neutralize": True, "orthogonalize": True}])
def test_artifacts(spark, panel, tmp_path, switches):
    config = pl.PipelineConfig(as_of=END, output_dir=str(tmp_path / "a" / "b"), **switches)
    out = pl.run_pipeline(panel, [SIZE, VALUE], config)
    stored, meta = spark.read.parquet(out.paths[0]), json.load(open(out.paths[1]))
    assert stored.count() == meta["rows"] == 90 and stored.columns == ["Date", "Ticker", "size", "value"] and meta["last_date"] == END and [f["name"] for f in meta["factors"]] == ["size", "value"]
    assert meta["factors"][0]["missing"] == stored.where("size is null").count() and stored.where("isnan(size) or isnan(value)").count() == 0
    with pytest.raises(FileExistsError):
        pl.run_pipeline(panel, [SIZE, VALUE], config)
    again = pl.run_pipeline(panel, [SIZE], pl.PipelineConfig(as_of=END, output_dir=str(tmp_path / "a" / "b"), overwrite=True))
    assert spark.read.parquet(again.paths[0]).columns == ["Date", "Ticker", "size"]
    assert sorted(p.name for p in (tmp_path / "a" / "b").iterdir() if not p.name.endswith(".crc")) == ["exposures.parquet", "metadata.json"]


def test_guards(panel):
    for wrong, error in (({"as_of": 7}, TypeError), ({"as_of": "not a day"}, ValueError), ({"as_of": dt.datetime.now(dt.UTC)}, ValueError), ({"orthogonalize": "yes"}, TypeError), ({"lower_quantile": None}, TypeError), ({"lower_quantile": 0.9, "upper_quantile": 0.2}, ValueError), ({"correlation_threshold": 2}, ValueError), ({"ddof": 1.0}, TypeError), ({"exposures_name": "up/x"}, ValueError)):
        with pytest.raises(error):
            pl.PipelineConfig(**({"as_of": END} | wrong))
    for call in (lambda: pl.filter_as_of(panel, "1980-01-01"), lambda: pl.run_pipeline(panel.drop("gics_sector"), [SIZE], pl.PipelineConfig(as_of=END, neutralize=True)), lambda: pl.run_pipeline(panel, [], pl.PipelineConfig(as_of=END))):
        with pytest.raises(ValueError):
            call()


def test_final_checks(spark, panel):
    x = panel.select("Date", "Ticker", "market_cap")
    pl.validate_final_exposures(x, panel, ["market_cap"], day(11))
    infinite = x.withColumn("market_cap", x.market_cap * float("inf"))
    for bad, last in ((x, END), (x.limit(50), day(11)), (x.union(x.limit(1)), day(11)), (infinite, day(11)), (x.select("Ticker", "Date", "market_cap"), day(11)), (x.withColumn("market_cap", x.market_cap.cast("string")), day(11))):
        with pytest.raises(ValueError):
            pl.validate_final_exposures(bad, panel, ["market_cap"], last)


def test_validation_report(spark, panel, tmp_path):
    x = panel.select("Date", "Ticker", "market_cap")
    y = panel.select("Date", "Ticker", panel.pb.alias("forward_return"))
    out = validation.validate_factors(x, y, validation.ValidationConfig(quantiles=2, min_cross_section=4, min_dates=3))
    paths = pl.write_validation_report(out, str(tmp_path / "report"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["daily.parquet", "summary.parquet", "quantiles.parquet", "correlations.parquet", "summary.json"]
    assert json.load(open(paths[-1]))["market_cap"]["n_dates"] == 12 and spark.read.parquet(paths[0]).count() == 12
    with pytest.raises(FileExistsError):
        pl.write_validation_report(out, str(tmp_path / "report"))
