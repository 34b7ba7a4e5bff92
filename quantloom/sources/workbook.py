"""Market workbooks (XLSX): cells as a DataFrame, and the panel's tables as joins and groupings of cells.

A cell is a row (sheet, row, col, value), both numbers from 1 and the value as text: numbers and dates as the file caches
them, error texts such as #N/A as they stand. Sheets are read in tasks of their own. Prices and descriptors are laid out
in blocks of columns, one block a security in the order of the universe; all reshaping is done on cells.
"""

from __future__ import annotations

import zipfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.expressions import KEYS
from ..functions.shipping import ship
from ..operators.joins import duplicate_keys
from .files import absolute, exists, is_folder
from .scratch import join_measured, stored
from .tables import excel_date, number_of

CELLS = "sheet string, row int, col int, value string"
SHEETS = ("Config", "Universe", "Prices", "Descriptors_TS", "Industries", "Meta")
# Fixed names of the layout: fields in the order of their columns, and the panel's names for them.
DAILY = {"CUR_MKT_CAP": "market_cap", "PX_TO_BOOK_RATIO": "pb", "EARN_YLD": "earn_yld", "VOLUME": "volume", "BETA_ADJ_OVERRIDABLE": "beta"}
GROWTH = {"SALES_GROWTH": "growth_sales", "EPS_GROWTH": "growth_eps"}
LEVERAGE = {"TOT_DEBT_TO_COM_EQY": "leverage"}
INDUSTRIES = {"gics_sector": "gics_sector", "gics_industry_grp": "gics_industry_group", "gics_sub_ind": "gics_sub_industry"}
EPOCHS = {False: "1899-12-30", True: "1904-01-01"}


def workbook_path(path) -> str:
    """The path, on any file system, with ~ expanded; an error if it isn't an .xlsx file."""
    spark, p = SparkSession.active(), absolute(path)
    if not p.lower().endswith(".xlsx") or is_folder(spark, p):
        raise ValueError(f"a workbook is a file that ends in .xlsx: {p}")
    if not exists(spark, p):
        raise FileNotFoundError(f"there is no workbook at {p}")
    return p


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _contents(workbook: bytes, relations: bytes) -> tuple[dict[str, str], bool]:
    """Each sheet's part of the file, in order, and whether days count from 1904."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(workbook)
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(relations)}
    where = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    settings = root.find(f"{_MAIN}workbookPr")
    return {s.get("name"): where(links[s.get(_LINK)]) for s in root.iter(f"{_MAIN}sheet")}, settings is not None and settings.get("date1904") in ("1", "true")


def _file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _outline(spark: SparkSession, path: str) -> tuple[dict[str, str], bool]:
    """_contents of a file on any file system: a task opens it and sends back its two small parts."""

    def parts(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    yield pd.DataFrame([(book.read("xl/workbook.xml"), book.read("xl/_rels/workbook.xml.rels"))], columns=["a", "b"])

    row = _file(spark, path).mapInPandas(parts, "a binary, b binary").first()
    return _contents(bytes(row["a"]), bytes(row["b"]))


def _cell_reader():
    """A function for tasks, which have no need of this package: (row, col, value) of a sheet's cells that hold something."""
    main = _MAIN

    def column(reference: str) -> int:
        n = 0
        for c in reference:
            if c.isdigit():
                break
            n = n * 26 + ord(c) - 64
        return n

    def read(book, part: str):
        from xml.etree import ElementTree

        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        row = col = 0
        with book.open(part) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    if e.tag == f"{main}row":
                        row, col = int(e.get("r", row + 1)), 0
                    continue
                if e.tag == f"{main}c":
                    col = column(e.get("r")) if e.get("r") else col + 1
                    kind, v = e.get("t"), e.find(f"{main}v")
                    text = "".join(t.text or "" for t in e.iter(f"{main}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                    if text is not None:
                        yield row, col, text
                elif e.tag == f"{main}row":
                    e.clear()

    return read


def read_workbook(spark: SparkSession, path, sheets: Sequence[str] = SHEETS) -> tuple[DataFrame, str]:
    """The cells of a workbook's sheets, and the day from which its serial dates count.

    The file may be on any file system of Spark's. ValueError where a sheet is missing. Each sheet is parsed in a task of its
    own, some rows at a time."""
    p = workbook_path(path)
    parts, late = _outline(spark, p)
    if missing := [s for s in sheets if s not in parts]:
        raise ValueError(f"sheets are missing: {missing}")
    read = _cell_reader()

    def parse(batches):
        import io
        from itertools import islice

        import pandas as pd

        for pdf in batches:
            for content, sheet, part in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    cells = read(book, part)
                    while block := list(islice(cells, 50_000)):
                        yield pd.DataFrame([(sheet, *c) for c in block], columns=["sheet", "row", "col", "value"])

    # a task for each sheet, which reads the file by itself: nothing of it goes through a shuffle
    files = [_file(spark, p).select("content", F.lit(s).alias("sheet"), F.lit(parts[s]).alias("part")) for s in sheets]
    return reduce(DataFrame.unionAll, files).mapInPandas(parse, CELLS), EPOCHS[late]


def read_volumes(spark: SparkSession, paths: Sequence[str], sheets: Sequence[str] = SHEETS) -> DataFrame:
    """volume and cells of workbooks whose names end in their numbers, as write_volumes names them; days count from 1899."""
    ship(spark)
    read = _cell_reader()

    def parse(batches):
        import io
        from itertools import islice

        import pandas as pd

        for pdf in batches:
            for content, sheet, volume in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    parts, late = _contents(book.read("xl/workbook.xml"), book.read("xl/_rels/workbook.xml.rels"))
                    if sheet not in parts or late:
                        raise ValueError(f"volume {volume} lacks {sheet}, or counts days from 1904")
                    cells = read(book, parts[sheet])
                    while block := list(islice(cells, 50_000)):
                        yield pd.DataFrame([(volume, sheet, *c) for c in block], columns=["volume", "sheet", "row", "col", "value"])

    number = F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("int")
    files = [spark.read.format("binaryFile").load(list(paths)).select("content", F.lit(s).alias("sheet"), number.alias("volume")) for s in sheets]
    return reduce(DataFrame.unionAll, files).mapInPandas(parse, f"volume int, {CELLS}")


def _width() -> Column:
    return F.when(F.col("sheet") == "Prices", 2).when(F.col("sheet") == "Descriptors_TS", len(_DESCRIPTORS))


def _moved(cells: DataFrame, by) -> DataFrame:
    """Cells of securities moved by a number of securities: along columns in sheets of blocks, else along rows."""
    return cells.withColumns({"row": (F.col("row") + F.when(_width().isNull(), by).otherwise(0)).cast("int"), "col": (F.col("col") + F.coalesce(_width() * by, F.lit(0))).cast("int")}).select("volume", "sheet", "row", "col", "value")


_LISTED = "sheet in ('Prices', 'Descriptors_TS') or sheet in ('Universe', 'Industries') and row > 1"


def _stated(cells: DataFrame, number) -> DataFrame:
    """Cells with another n_securities in Meta."""
    at = cells.where("sheet = 'Meta' and col = 1 and value = 'n_securities'").agg(F.max("row")).first()[0]
    return cells if at is None else cells.withColumn("value", F.when((F.col("sheet") == "Meta") & (F.col("row") == at) & (F.col("col") == 2), number.cast("string")).otherwise(F.col("value")))


def split_volumes(cells: DataFrame, per: int) -> DataFrame:
    """volume and cells: a workbook of any number of securities as workbooks of `per` at the most, in order."""
    n = cells.where("sheet = 'Universe' and col = 1 and row > 1").count()
    place = F.when(_width().isNotNull(), F.floor((F.col("col") - 1) / _width())).otherwise(F.col("row") - 2)
    own = cells.where(_LISTED).withColumn("volume", F.floor(place / per).cast("int"))
    volumes = F.broadcast(cells.sparkSession.range(max(1, -(-n // per))).select(F.col("id").cast("int").alias("volume")))
    common = cells.where(f"not ({_LISTED})").crossJoin(volumes)
    common = _stated(common, F.least(F.lit(per), F.lit(n) - F.col("volume") * per)).select("volume", "sheet", "row", "col", "value")
    return _moved(own, -F.col("volume") * per).unionByName(common)


def join_volumes(cells: DataFrame) -> DataFrame:
    """split_volumes' other way round: volumes as the cells of one workbook."""
    sizes = {r["volume"]: r["n"] for r in cells.where("sheet = 'Universe' and col = 1").groupBy("volume").agg(F.count_if(F.col("row") > 1).alias("n")).collect()}  # a row a volume
    before, total = [], 0
    for volume in sorted(sizes):
        before.append((volume, total))
        total += sizes[volume]
    offsets = F.broadcast(cells.sparkSession.createDataFrame(before, "volume int, before int"))
    own = _moved(cells.where(_LISTED).join(offsets, "volume"), F.col("before"))
    common = _stated(cells.where(f"not ({_LISTED})").where(F.col("volume") == before[0][0]), F.lit(total)).select("volume", "sheet", "row", "col", "value")
    return own.unionByName(common).drop("volume")


def key_values(cells: DataFrame, sheet: str) -> dict[str, str | None]:
    """A small sheet's first two columns; of a key's rows the last counts."""
    rows = cells.where((F.col("sheet") == sheet) & (F.col("col") <= 2)).groupBy("row").pivot("col", [1, 2]).agg(F.first("value")).where("`1` is not null").orderBy("row").collect()
    return {r["1"]: r["2"] for r in rows}


def inspect_workbook(spark: SparkSession, path) -> dict:
    """sheet_names, sheet_dimensions (rows, columns), config and meta."""
    names = list(_outline(spark, workbook_path(path))[0])
    cells = read_workbook(spark, path)[0]
    sizes = {r["sheet"]: (r["rows"], r["columns"]) for r in cells.groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("columns")).collect()}
    return {"sheet_names": names, "sheet_dimensions": {s: sizes.get(s, (0, 0)) for s in SHEETS}, "config": key_values(cells, "Config"), "meta": key_values(cells, "Meta")}


def universe(cells: DataFrame) -> DataFrame:
    """position (from 0, in the sheet's order) and Ticker; ValueError for a wrong header, blank or repeated tickers, or
    another number than Meta's n_securities."""
    own = cells.where("sheet = 'Universe' and col = 1").select("row", F.trim("value").alias("Ticker"))
    names = own.where("row > 1")
    facts = own.agg(F.max(F.when(F.col("row") == 1, F.col("Ticker"))).alias("header"), F.count_if((F.col("row") > 1) & (F.col("Ticker") == "")).alias("blank"), F.count_if(F.col("row") > 1).alias("n"), F.count_distinct(F.when(F.col("row") > 1, F.col("Ticker"))).alias("different")).first()
    if facts["header"] != "ticker":
        raise ValueError("the first cell of Universe must be 'ticker'")
    if facts["blank"]:
        raise ValueError("Universe holds blank tickers")
    if facts["different"] < facts["n"]:
        raise ValueError("Universe holds a ticker twice")
    stated = key_values(cells, "Meta").get("n_securities")
    if stated is not None and int(float(stated)) != facts["n"]:
        raise ValueError(f"Universe has {facts['n']} tickers, Meta says {stated}")
    # one row a security: the order of a sheet's column
    return names.select((F.row_number().over(Window.orderBy("row")) - 1).alias("position"), "Ticker")


def _blocks(cells: DataFrame, tickers: DataFrame, sheet: str, header: Sequence[str | None]) -> DataFrame:
    """row, position, at (column of its block, from 0) and value below the header. header: what each column of a block must
    be called (None: the ticker, "": anything); ValueError where it isn't, or the sheet has another width."""
    width = len(header)
    own = cells.where(F.col("sheet") == sheet).select("row", F.floor((F.col("col") - 1) / width).cast("int").alias("position"), ((F.col("col") - 1) % width).alias("at"), "col", "value")
    n = tickers.count()
    if (last := own.agg(F.max("col")).first()[0]) != n * width:
        raise ValueError(f"{sheet} must have {n * width} columns, not {last}")
    titles = F.array(*[F.lit("\0" if t is None else t) for t in header])
    wanted = tickers.select("position", "Ticker", F.posexplode(titles).alias("at", "title")).where("title <> ''").withColumn("title", F.when(F.col("title") == "\0", F.col("Ticker")).otherwise(F.col("title")))
    wrong = wanted.join(own.where("row = 1").select("position", "at", "value"), ["position", "at"], "left").where("not (value <=> title)").orderBy("position", "at").first()
    if wrong is not None:
        raise ValueError(f"{sheet}, block {wrong['position']}, column {wrong['at']}: {wrong['title']!r} was expected, not {wrong['value']!r}")
    return own.where("row > 1").select("row", "position", "at", "value")


def _dated(blocks: DataFrame, tickers: DataFrame, parts: Mapping[int, Mapping[int, str]], epoch: str, sheet: str) -> list[DataFrame]:
    """For each part, by the column of its date, a table of Date, Ticker and its fields as numbers, of the rows with a date;
    ValueError for what is no date, and for repeated keys. Cells are gathered to rows once for all parts, and the tickers
    join these rows, which are checked and read from where they are stored."""
    fields = {k: n for own in parts.values() for k, n in own.items()}
    held = blocks.groupBy("position", "row").agg(*[F.max(F.when(F.col("at") == k, F.col("value"))).alias(f"d{k}") for k in parts], *[F.max(F.when(F.col("at") == k, number_of(F.col("value")))).alias(n) for k, n in fields.items()])
    held = join_measured(held, tickers, ["position"], "inner").select("Ticker", *[x for k in parts for x in (excel_date(F.col(f"d{k}"), epoch).alias(f"date{k}"), f"d{k}")], *fields.values())
    held = stored(held, "sheet-rows")
    out = []
    for k, own in parts.items():
        if not held.where(f"date{k} is null and d{k} is not null and not startswith(d{k}, '#')").isEmpty():
            raise ValueError(f"{sheet} holds a date that isn't one")
        dated = held.select(F.col(f"date{k}").alias("Date"), "Ticker", *own.values()).where("Date is not null")
        if not duplicate_keys(dated).isEmpty():
            raise ValueError(f"{sheet} holds a (Date, Ticker) twice")
        out.append(dated)
    return out


def prices(cells: DataFrame, tickers: DataFrame, epoch: str = EPOCHS[False]) -> DataFrame:
    """Date, Ticker, px_last from blocks of two columns, date and price, headed by the ticker; errors are missing prices."""
    return _dated(_blocks(cells, tickers, "Prices", ("", None)), tickers, {0: {1: "px_last"}}, epoch, "Prices")[0]


_DESCRIPTORS = (None, *DAILY, None, *GROWTH, None, *LEVERAGE)
#: Columns of a security in the widest sheet.
WIDTH = len(_DESCRIPTORS)


def descriptors(cells: DataFrame, tickers: DataFrame, epoch: str = EPOCHS[False]) -> tuple[DataFrame, DataFrame]:
    """Daily and quarterly descriptors from blocks of eleven columns: a date with daily fields, one with growth rates and
    one with leverage. Quarterly rows are those of growth or leverage, whichever has the date."""
    blocks = _blocks(cells, tickers, "Descriptors_TS", _DESCRIPTORS)
    at = lambda first, names: {first + i: n for i, n in enumerate(names)}
    growth, leverage = len(DAILY) + 1, len(DAILY) + len(GROWTH) + 2
    parts = {first: at(first + 1, fields.values()) for first, fields in ((0, DAILY), (growth, GROWTH), (leverage, LEVERAGE))}
    daily, *quarters = _dated(blocks, tickers, parts, epoch, "Descriptors_TS")
    return daily, quarterly_descriptors(*quarters)


def quarterly_descriptors(growth: DataFrame, leverage: DataFrame) -> DataFrame:
    """Both sides' keys, with NULL for what a side doesn't have."""
    return growth.join(leverage, list(KEYS), "full")


def industries(cells: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker and three industry columns; ValueError for another header, missing or error values, and unless the tickers
    are the universe's, in its order."""
    own = cells.where("sheet = 'Industries'")
    head = [r["value"] for r in own.where("row = 1").orderBy("col").collect()]
    if head != ["ticker", *INDUSTRIES]:
        raise ValueError(f"Industries must be headed ticker, {', '.join(INDUSTRIES)}")
    wide = own.where("row > 1").groupBy("row").pivot("col", list(range(1, len(head) + 1))).agg(F.first("value"))
    wide = wide.select((F.col("row") - 2).alias("position"), F.trim("1").alias("Ticker"), *[F.trim(str(i + 2)).alias(n) for i, n in enumerate(INDUSTRIES.values())])
    if not wide.where(" or ".join(f"coalesce({n}, '') = '' or startswith({n}, '#')" for n in ("Ticker", *INDUSTRIES.values()))).isEmpty():
        raise ValueError("Industries holds missing values or errors")
    if not wide.join(tickers.withColumnRenamed("Ticker", "u"), "position", "full").where("not (Ticker <=> u)").isEmpty():
        raise ValueError("Industries must list the tickers of Universe, in their order")
    return wide.drop("position")


def diagnostics(cells: DataFrame, tickers: DataFrame) -> DataFrame:
    """sheet, row, Ticker, field and error of each error text among prices and descriptors."""
    fields = {"Prices": ("Date", "PX_LAST"), "Descriptors_TS": ("daily_date", *DAILY, "growth_date", *GROWTH, "leverage_date", *LEVERAGE)}
    out = None
    for sheet, names in fields.items():
        own = cells.where((F.col("sheet") == sheet) & (F.col("row") > 1) & F.startswith("value", F.lit("#")))
        named = own.select("sheet", "row", F.floor((F.col("col") - 1) / len(names)).cast("int").alias("position"), F.get(F.array(*map(F.lit, names)), (F.col("col") - 1) % len(names)).alias("field"), F.col("value").alias("error"))
        named = named.join(tickers, "position").select("sheet", "row", "Ticker", "field", "error")
        out = named if out is None else out.unionByName(named)
    return out


def panel_tables(cells: DataFrame, epoch: str = EPOCHS[False]) -> dict[str, DataFrame]:
    """prices, daily, quarterly and industries of a workbook's cells, checked."""
    tickers = stored(universe(cells), "universe")
    daily, quarterly = descriptors(cells, tickers, epoch)
    out = {"prices": prices(cells, tickers, epoch), "daily": daily, "quarterly": quarterly, "industries": industries(cells, tickers)}
    return out
