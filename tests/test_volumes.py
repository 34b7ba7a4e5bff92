"""Workbooks of more securities than a sheet has columns for, as volumes."""

from quantloom.plans import assembly_queries
from quantloom.sources import workbook
from quantloom.sources import workbook_sink
from quantloom.sources.workbook_sink import write_volumes

SMOKE = "/root/testdata/sf0.001"


def test_volumes_read_back_as_one_workbook(spark, tmp_path):
    cells = assembly_queries.workbook_cells(spark, SMOKE)
    n = cells.where("sheet = 'Universe' and row > 1").count()
    per = n // 3 + 1 if n % 3 != 1 else n // 3
    paths = write_volumes(workbook.split_volumes(cells, per), str(tmp_path / "books"))
    assert len(paths) == -(-n // per) > 1
    first, epoch = workbook.read_workbook(spark, paths[0])
    assert workbook.universe(first).count() == per and epoch == workbook.EPOCHS[False]
    key = lambda df: sorted(map(tuple, df.select("sheet", "row", "col", "value").collect()))
    assert key(workbook.join_volumes(workbook.read_volumes(spark, paths))) == key(cells)


def test_volumes_are_made_side_by_side(spark, tmp_path):
    """One job makes them all, a task a volume; before, each was a job of its own that waited for the one before it."""
    rows = [(v, s, r, c, f"{v}{r}{c}") for v in range(6) for s in ("A", "B") for r in (1, 2) for c in (1, 2, 30)]
    cells = spark.createDataFrame(rows, "volume int, sheet string, row int, col int, value string").coalesce(2)
    spark.sparkContext.setJobGroup("side-by-side", "volumes")
    paths = write_volumes(cells, str(tmp_path / "books"))
    spark.sparkContext.setJobGroup("other", "other")
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(i) for j in told.getJobIdsForGroup("side-by-side") for i in told.getJobInfo(j).stageIds]
    assert any(i is not None and i.numTasks >= len(paths) for i in stages)  # there are fewer tasks that read the rows
    got = sorted(map(tuple, workbook.read_volumes(spark, paths, ["A", "B"]).collect()))
    assert len(paths) == 6 and got == sorted(rows)


def test_rows_of_cells_as_xml(spark):
    values = ["1", "-0.5e3", "01", "1.", "#N/A N/A", "#a<b", "a & b <c>", "\x01x\ufffe", "", "1\n", " é😀", "TRUE"]
    columns = [1, 2, 26, 27, 52, 53, 702, 703, 728, 729, 16383, 16384]
    cells = spark.createDataFrame([("s", 7, c, v) for c, v in zip(columns[::-1], values, strict=True)] + [("s", 7, 5, None)], "sheet string, row int, col int, value string")
    line = workbook_sink._lines(cells, "sheet").collect()
    assert [(r["sheet"], r["row"]) for r in line] == [("s", 7)]
    assert line[0]["line"] == "".join(workbook_sink._cell(7, c, v) for c, v in zip(columns, values[::-1], strict=True))
