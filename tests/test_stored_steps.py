"""Costly steps of queries are worked out once and read again."""

import pytest

from quantloom.plans import assembly_queries, queries, source_queries
from quantloom.sources import workbook

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("run", [lambda s: queries.validated(s, SMOKE), lambda s: queries.QUERIES["aligned_labels"](s, SMOKE)])
def test_one_panel_for_exposures_and_labels(spark, monkeypatch, run):
    calls = []
    for module in (queries, source_queries):
        own = module.panel
        monkeypatch.setattr(module, "panel", lambda *a, own=own: calls.append(1) or own(*a))
    run(spark)
    assert len(calls) == 1


def test_cells_are_gathered_to_rows_once(spark):
    cells = assembly_queries.workbook_cells(spark, SMOKE)
    tickers = workbook.universe(cells)
    for table in (*workbook.descriptors(cells, tickers), workbook.prices(cells, tickers)):
        assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
