import datetime as dt

import pytest
from helpers import day
from pyspark.sql import functions as F

from quantloom.sources import files, tables as st


@pytest.fixture()
def csv(tmp_path):
    """Tickers with leading zeros and blanks around them, a missing number, a date column."""
    p = tmp_path / "quotes.csv"
    p.write_text("when,code,price,lots\n2020-06-02, 00700 ,51.25,10\n2020-06-01,00005,,7\n2020-06-01, 0388,290.5,\n")
    return p


def test_preview_types_its_own_lines(spark, csv):
    csv.write_text(csv.read_text() + "never,read,as a number,x\n")
    assert st.inspect_csv(spark, csv, nrows=2).dtypes == [("when", "date"), ("code", "string"), ("price", "double"), ("lots", "bigint")]
    assert st.inspect_csv(spark, csv, nrows=50).count() == 4
    for n, error in ((1.0, TypeError), (True, TypeError), (-1, ValueError)):
        with pytest.raises(error):
            st.inspect_csv(spark, csv, nrows=n)


def test_profile(spark, csv):
    got = [tuple(r) for r in st.describe_columns(st.load_raw_csv(spark, csv)).collect()]
    assert [r[0] for r in got] == ["when", "code", "price", "lots"] and [r[2:] for r in got] == [(3, 0), (3, 0), (2, 1), (2, 1)]


def test_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n1\n")
    (tmp_path / "dir.csv").mkdir()
    for bad, error in ((tmp_path / "absent.csv", FileNotFoundError), (tmp_path / "a.txt", ValueError), (tmp_path / "dir.csv", ValueError)):
        with pytest.raises(error):
            st.load_raw_csv(spark, bad)


def test_csv_to_parquet_casts_what_is_declared(spark, csv, tmp_path):
    out = st.csv_to_parquet(spark, csv, tmp_path / "q.parquet", parse_dates=["when"], numeric_cols=["price"])
    back = spark.read.parquet(out)
    assert back.dtypes == [("when", "date"), ("code", "string"), ("price", "double"), ("lots", "string")] and {r.code.strip() for r in back.collect()} == {"00700", "00005", "0388"}
    with pytest.raises(FileExistsError):
        st.csv_to_parquet(spark, csv, out)
    st.csv_to_parquet(spark, csv, out, numeric_cols=["price"], keep_cols=["code", "price"], winsorize_quantile=0.25, overwrite=True)
    assert sorted(r.price for r in spark.read.parquet(out).where("price is not null").collect()) == pytest.approx([51.25 + 0.25 * 239.25, 51.25 + 0.75 * 239.25])
    for wrong in ({"numeric_cols": ["absent"]}, {"keep_cols": ["absent"]}, {"parse_dates": ["absent"]}):
        with pytest.raises(ValueError):
            st.csv_to_parquet(spark, csv, tmp_path / "z.parquet", **wrong)
    with pytest.raises(Exception):  # noqa: B017  what isn't a number stops the job
        st.csv_to_parquet(spark, csv, tmp_path / "y.parquet", numeric_cols=["when"])
    (tmp_path / "other.csv").write_text("a\nb\n")
    assert [p.rsplit("/", 1)[1] for p in st.convert_csv_dir(spark, tmp_path, tmp_path / "done", numeric_cols=["lots"])] == ["quotes.parquet"]
    with pytest.raises(FileNotFoundError):
        st.convert_csv_dir(spark, tmp_path / "absent")


def test_parquet_scan_prunes_and_drops_nan(spark, tmp_path):
    spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, 0.5)], "k long, v double").write.parquet(str(tmp_path / "n.parquet"))
    df = st.load_parquet(spark, tmp_path / "n.parquet", columns=["k"], filters=F.col("v") > 1)
    assert [r.k for r in df.collect()] == [1]  # NaN is larger than all numbers to Spark, and missing here
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,1.0)]" in plan
    assert st.load_parquet(spark, tmp_path / "n.parquet").where("v is null").count() == 1
    with pytest.raises(ValueError):
        st.save_parquet(spark.range(0), tmp_path / "e.parquet")
    with pytest.raises(ValueError):
        st.save_parquet(spark.range(2), tmp_path / "e.parquet", partition_cols=["absent"])


def test_long_panel(spark, csv):
    raw = st.load_raw_csv(spark, csv, infer=False)
    got = st.standardize_long_panel(raw, date_column="when", ticker_column="code", column_mapping={"price": "px_last"})
    assert got.columns == ["Date", "Ticker", "px_last", "lots"] and [(r.Date.day, r.Ticker) for r in got.collect()] == [(1, "00005"), (1, "0388"), (2, "00700")]
    names = {"date_column": "when", "ticker_column": "code"}
    for bad in (raw.union(raw), raw.withColumn("code", F.lit("  ")), raw.withColumn("when", F.lit(None).cast("string")), raw.drop("code")):
        with pytest.raises(ValueError):
            st.standardize_long_panel(bad, **names)
    for mapping in ({"absent": "x"}, {"code": "x"}, {"price": "lots"}, {"price": "Ticker"}):
        with pytest.raises(ValueError):
            st.standardize_long_panel(raw, **names, column_mapping=mapping)


def test_values_and_dates(spark):
    texts = {"43985": dt.date(2020, 6, 3), "43985.75": dt.date(2020, 6, 3), "20200603": dt.date(2020, 6, 3), "2020-06-03": dt.date(2020, 6, 3), "#N/A": None, "99999999": None, "-5": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.d for r in df.select("t", st.excel_date(F.col("t")).alias("d")).collect()} == texts
    assert df.where("t = '43985'").select(st.excel_date(F.col("t"), "1904-01-01").alias("d")).first().d == dt.date(2024, 6, 4)
    numbers = spark.createDataFrame([("#REF!",), ("1e3",), ("NaN",), (None,)], "t string").select(st.number_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [None, 1000.0, None, None]


def test_fields_to_columns(spark):
    rows = [(day(0), "k", "VOL", 4.0), (day(0), "k", "VOL", 8.0), (day(0), "k", "CAP", 1.0), (day(1), "k", "CAP", None), (day(0), "q", "JUNK", 3.0)]
    long = spark.createDataFrame(rows, "date date, ticker string, field string, value double")
    wide = st.pivot_descriptors(long, {"VOL": "volume", "CAP": "market_cap"})
    assert [tuple(r) for r in wide.collect()] == [(day(0), "k", 6.0, 1.0)]
    panel = st.contract_panel(wide)
    assert panel.schema.names == st.contract_schema().names and panel.first().volume == 6.0 and panel.first().pb is None
    assert [tuple(r) for r in st.keyed_mean(long.where("field = 'VOL'"), "value", name="tr").collect()] == [(day(0), "k", 6.0)]


def test_whole_files(spark, tmp_path):
    target = files.joined(tmp_path, "deep/er/t.json")
    files.write_json(spark, target, {"b": 1, "a": [1.5, None]})
    assert files.read_text(spark, target).startswith('{\n "a"')
    with pytest.raises(FileExistsError):
        files.write_text(spark, target, "x")
    files.write_text(spark, target, "x", overwrite=True)
    with pytest.raises(ValueError):
        files.write_json(spark, target, {"a": float("nan")}, overwrite=True)
    table = files.joined(tmp_path, "t.parquet")
    files.write_whole(spark.range(3), table)
    files.write_whole(spark.range(5), table, overwrite=True, compression="gzip")
    assert spark.read.parquet(table).count() == 5 and files.read_text(spark, target) == "x"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deep", "t.parquet"]  # nothing is left beside them
    with pytest.raises(FileNotFoundError):
        files.read_text(spark, files.joined(tmp_path, "absent"))
