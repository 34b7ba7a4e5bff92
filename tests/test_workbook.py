"""Workbooks written here as plain XML, and cells that break a rule each."""

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quantloom.plans import assembly
from quantloom.sources import workbook as wb

TICKERS = ["ORE LN", "FIG LN", "ELM LN"]
SECTORS = [("Metals", "Mining", "Ore"), ("Food", "Fruit", "Figs"), ("Timber", "Hardwood", "Elm")]


def serial(y, m, d):
    return (dt.date(y, m, d) - dt.date(1899, 12, 30)).days


def sheets():
    """Rows of each sheet; None is an empty cell."""
    prices = [[x for t in TICKERS for x in ("date", t)]]
    prices += [[serial(2021, 5, 3), 10.5, serial(2021, 5, 3), 7, "2021-05-04", 3.25], [serial(2021, 5, 4), "#N/A N/A", serial(2021, 5, 5), 8.0, None, None], [serial(2021, 6, 1), 11, "#VALUE!", 9.0, None, 4.0]]
    head = [x for t in TICKERS for x in (t, *wb.DAILY, t, *wb.GROWTH, t, *wb.LEVERAGE)]
    first = [serial(2021, 5, 3), 100.0, 1.5, 0.04, 900, "#N/A", serial(2021, 3, 31), 0.1, 0.2, serial(2021, 4, 15), 55.5]
    other = [serial(2021, 5, 4), 200.0, None, 0.05, 800, 1.1, serial(2021, 5, 20), 0.3, None, None, None]
    empty = [None] * 11
    return {
        "Config": [["source", "desk"], ["currency", "GBP"]],
        "Universe": [["ticker"], *[[f" {t} "] for t in TICKERS]],
        "Prices": prices,
        "Descriptors_TS": [head, first + empty + other, other + first + empty],
        "Industries": [["ticker", *wb.INDUSTRIES], *[[t, *s] for t, s in zip(TICKERS, SECTORS)]],
        "Meta": [["n_securities", 3], ["made", "today"]],
    }


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path, content, late=False):
    strings = []
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(r, c, v):
        at = f"{letters(c)}{r}"
        if isinstance(v, str) and v.startswith("#"):
            return f'<c r="{at}" t="e"><f>1/0</f><v>{escape(v)}</v></c>'
        if isinstance(v, str) and len(v) % 2:
            return f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if isinstance(v, str):
            strings.append(v)
            return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, rows in enumerate(content.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t xml:space=\"preserve\">{escape(s[1:])}</t></r></si>" for s in strings) + "</sst>")
        links = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} {links}><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if late else ""}/><sheets>' + "".join(f'<sheet name="{n}" r:id="rId{i}"/>' for i, n in enumerate(content, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(content) + 1)) + "</Relationships>")


def cells_of(spark, content):
    return spark.createDataFrame([(s, r, c, str(v)) for s, rows in content.items() for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None], wb.CELLS)


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = tmp_path_factory.mktemp("books") / "market.xlsx"
    write(path, sheets())
    return path


def test_cells_of_a_file(spark, book):
    cells, epoch = wb.read_workbook(spark, book)
    want = {(s, r, c, str(v)) for s, rows in sheets().items() for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None}
    assert {tuple(r) for r in cells.collect()} == want and epoch == "1899-12-30"
    seen = wb.inspect_workbook(spark, book)
    assert seen["sheet_names"] == list(sheets()) and seen["config"] == {"source": "desk", "currency": "GBP"} and seen["meta"]["n_securities"] == "3" and seen["sheet_dimensions"]["Prices"] == (4, 6)


def test_panel_of_a_file(spark, book):
    got = {(r.Date, r.Ticker): r for r in assembly.load_workbook_panel(spark, book).collect()}
    d = lambda m, k: dt.date(2021, m, k)
    assert set(got) == {(d(5, 3), "ORE LN"), (d(5, 4), "ORE LN"), (d(6, 1), "ORE LN"), (d(5, 3), "FIG LN"), (d(5, 5), "FIG LN"), (d(5, 4), "ELM LN")}
    ore = got[d(5, 3), "ORE LN"]
    assert (ore.px_last, ore.market_cap, ore.pb, ore.beta, ore.growth_sales, ore.leverage) == (10.5, 100.0, 1.5, None, None, 55.5)  # the latest quarterly row is leverage's alone
    assert got[d(5, 4), "ORE LN"].px_last is None and got[d(5, 4), "ORE LN"].market_cap == 200.0
    assert got[d(6, 1), "ORE LN"].growth_sales == 0.3 and got[d(6, 1), "ORE LN"].leverage is None and got[d(6, 1), "ORE LN"].gics_sector == "Metals"
    assert got[d(5, 3), "FIG LN"].growth_eps is None and got[d(5, 4), "ELM LN"].market_cap == 200.0 and got[d(5, 4), "ELM LN"].gics_sub_industry == "Elm"


def test_diagnostics(spark):
    cells = cells_of(spark, sheets())
    assert {tuple(r) for r in wb.diagnostics(cells, wb.universe(cells)).collect()} == {("Prices", 3, "ORE LN", "PX_LAST", "#N/A N/A"), ("Prices", 4, "FIG LN", "Date", "#VALUE!"), ("Descriptors_TS", 2, "ORE LN", "BETA_ADJ_OVERRIDABLE", "#N/A"), ("Descriptors_TS", 3, "FIG LN", "BETA_ADJ_OVERRIDABLE", "#N/A")}


def test_days_from_1904(spark, tmp_path):
    write(tmp_path / "late.xlsx", sheets(), late=True)
    cells, epoch = wb.read_workbook(spark, tmp_path / "late.xlsx")
    assert epoch == "1904-01-01" and wb.prices(cells, wb.universe(cells), epoch).agg(F.max("Date")).first()[0] == dt.date(2025, 6, 2)


def broken(change):
    content = sheets()
    change(content)
    return content


BREAKS = {
    "header": lambda c: c["Universe"][0].__setitem__(0, "name"), "blank": lambda c: c["Universe"][2].__setitem__(0, " "), "twice": lambda c: c["Universe"][2].__setitem__(0, "ORE LN"), "count": lambda c: c["Meta"][0].__setitem__(1, 4),
    "price head": lambda c: c["Prices"][0].__setitem__(3, "ORE LN"), "price width": lambda c: c["Prices"][0].append("more"), "price date": lambda c: c["Prices"][1].__setitem__(0, "soon"), "price twice": lambda c: c["Prices"][2].__setitem__(0, serial(2021, 5, 3)),
    "descriptor head": lambda c: c["Descriptors_TS"][0].__setitem__(8, "SALES"), "descriptor twice": lambda c: c["Descriptors_TS"][2].__setitem__(6, serial(2021, 3, 31)), "industry head": lambda c: c["Industries"][0].__setitem__(1, "sector"),
    "industry gap": lambda c: c["Industries"][2].__setitem__(2, None), "industry error": lambda c: c["Industries"][1].__setitem__(3, "#N/A"), "industry order": lambda c: c["Industries"].insert(1, c["Industries"].pop(2)), "industry more": lambda c: c["Industries"].append(["YEW LN", "a", "b", "c"]),
}


@pytest.mark.parametrize("name", BREAKS)
def test_broken_workbooks(spark, name):
    with pytest.raises(ValueError):
        assembly.workbook_panel(cells_of(spark, broken(BREAKS[name])))


def test_paths_and_sheets(spark, book, tmp_path):
    (tmp_path / "a.xls").write_bytes(book.read_bytes())
    (tmp_path / "d.xlsx").mkdir()
    for bad, error in ((tmp_path / "a.xls", ValueError), (tmp_path / "d.xlsx", ValueError), (tmp_path / "absent.xlsx", FileNotFoundError)):
        with pytest.raises(error):
            wb.workbook_path(bad)
    some = sheets()
    del some["Meta"]
    write(tmp_path / "part.xlsx", some)
    with pytest.raises(ValueError):
        wb.read_workbook(spark, tmp_path / "part.xlsx")


def test_assembly_refuses(spark, book):
    cells, epoch = wb.read_workbook(spark, book)
    parts = wb.panel_tables(cells, epoch)
    for name, wrong in (("prices", parts["prices"].union(parts["prices"])), ("daily", parts["daily"].drop("pb")), ("quarterly", parts["quarterly"].union(parts["quarterly"])), ("industries", parts["industries"].union(parts["industries"]))):
        with pytest.raises(ValueError):
            assembly.build_panel(**{**parts, name: wrong})


def test_field_sources(spark, tmp_path):
    """Entity-attribute-value tables under a root of one's own, with NaN as other libraries write it."""
    d, nan = dt.date(2022, 1, 4), float("nan")
    sources = assembly.FieldSources(str(tmp_path))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    put(sources.prices, [(d, "yew", 4.0), (d, "yew", 6.0), (d, "oak", nan)], "date date, ticker string, close double")
    put(sources.returns, [(d, "yew", 101.0), (d, "oak", 99.0)], "date date, ticker string, tr double")
    put(sources.daily, [(d, "yew", "VOLUME", 12.0), (d, "yew", "EARN_YLD", nan), (d, "yew", "OTHER", 1.0)], "date date, ticker string, field string, value double")
    put(sources.quarterly, [(d, "yew", "EPS_GROWTH", 0.5)], "date date, ticker string, field string, value double")
    put(sources.industries, [("yew", "a", "b", "c")], "ticker string, gics_sector string, gics_industry_grp string, gics_sub_ind string")
    r = assembly.load_field_panel(spark, sources).collect()
    assert len(r) == 1 and (r[0].px_last, r[0].volume, r[0].earn_yld, r[0].growth_eps, r[0].leverage, r[0].gics_industry_group) == (5.0, 12.0, None, 0.5, None, "b")
    assert {x.Ticker: x.tr for x in assembly.load_total_returns(spark, sources).collect()} == {"yew": 101.0, "oak": 99.0}


def test_written_cells_read_back(spark, tmp_path):
    """What the sink writes, the source reads: with a scheme in the path, and by name alone."""
    from quantloom.sources import workbook_sink

    content = sheets()
    content["Config"][0][1] = "a <b> & \"c\"\x01"
    cells = cells_of(spark, content)
    path = workbook_sink.write_cells(cells.repartition(5), f"file://{tmp_path}/deep/w.xlsx")
    back, epoch = wb.read_workbook(spark, path)
    fixed = lambda df: sorted((r["sheet"], r["row"], r["col"], r["value"].replace("\x01", "�")) for r in df.collect())
    assert fixed(back) == fixed(cells) and epoch == wb.EPOCHS[False]
    want = sorted(map(str, assembly.workbook_panel(cells).collect()))
    assert sorted(map(str, assembly.load_workbook_panel(spark, f"{tmp_path}/deep/w.xlsx").collect())) == want
    for call, error in ((lambda: workbook_sink.write_cells(cells, path), FileExistsError), (lambda: workbook_sink.write_cells(cells, f"{tmp_path}/w.txt"), ValueError), (lambda: workbook_sink.write_cells(cells.withColumn("row", F.lit(2_000_000)), f"{tmp_path}/far.xlsx"), ValueError)):
        with pytest.raises(error):
            call()


def test_allocation_report(spark, tmp_path):
    from quantloom.sources import workbook_sink

    weights = spark.createDataFrame([("oak", 0.625), ("yew", 0.375), ("#ash", None)], "Ticker string, weight double")
    path = workbook_sink.allocation_report(weights, tmp_path / "report.xlsx")
    got = {(r["row"], r["col"]): r["value"] for r in wb.read_workbook(spark, path, ["Portfolio Allocation"])[0].collect()}
    assert got == {(1, 1): "Ticker", (1, 2): "Optimal_Weight", (2, 1): "oak", (2, 2): "0.625", (3, 1): "yew", (3, 2): "0.375", (4, 1): "#ash"}
    with zipfile.ZipFile(tmp_path / "report.xlsx") as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
    assert '<c r="B2" s="2"><v>0.625</v></c>' in sheet and '<col min="1" max="1" width="20" customWidth="1"/>' in sheet and styles.count("numFmtId") == 3 and 'numFmtId="10"' in styles
    dated = spark.createDataFrame([(dt.date(2021, 5, 3), 2, True, None), (None, None, None, float("nan"))], "d date, n int, b boolean, x double")
    workbook_sink.write_tables(spark, tmp_path / "report.xlsx", {"a": dated, "b": dated.limit(0)}, overwrite=True)
    got = {(r["sheet"], r["row"], r["col"]): r["value"] for r in wb.read_workbook(spark, tmp_path / "report.xlsx", ["a", "b"])[0].collect()}
    assert got == {("a", 1, 1): "d", ("a", 1, 2): "n", ("a", 1, 3): "b", ("a", 1, 4): "x", ("a", 2, 1): str(serial(2021, 5, 3)), ("a", 2, 2): "2", ("a", 2, 3): "1", ("b", 1, 1): "d", ("b", 1, 2): "n", ("b", 1, 3): "b", ("b", 1, 4): "x"}
