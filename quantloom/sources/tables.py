"""CSV and Parquet sources and sinks, and normalizers that make keyed panels of them."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.expressions import KEYS, without_nan
from ..operators.joins import duplicate_keys
from ..operators.transforms import winsorize_pooled
from .files import absolute, exists, is_folder, joined, listed

log = logging.getLogger(__name__)

#: The panel contract: columns in order.
CONTRACT = {n: "double" for n in ("px_last", "market_cap", "pb", "earn_yld", "beta", "volume", "growth_sales", "growth_eps", "leverage")} | {n: "string" for n in ("gics_sector", "gics_industry_group", "gics_sub_industry")}


def csv_path(spark: SparkSession, path) -> str:
    """The path, on any file system, with ~ expanded; an error if it isn't a .csv file (or what Spark wrote under such a name)."""
    p = absolute(path)
    if not p.lower().endswith(".csv") or (is_folder(spark, p) and not exists(spark, joined(p, "_SUCCESS"))):
        raise ValueError(f"a CSV source is a file that ends in .csv: {p}")
    if not exists(spark, p):
        raise FileNotFoundError(f"there is no CSV file at {p}")
    return p


def load_raw_csv(spark: SparkSession, path, *, encoding: str = "utf-8", infer: bool = True, **options) -> DataFrame:
    """All columns, typed by a scan of their own; infer=False: as text, read once."""
    return without_nan(spark.read.options(header=True, inferSchema=infer, encoding=encoding, **options).csv(csv_path(spark, path)))


def inspect_csv(spark: SparkSession, path, *, nrows: int = 10, encoding: str = "utf-8", **options) -> DataFrame:
    """The first nrows rows, typed by themselves (leading zeros make a text): no more of the file is read than their lines."""
    if isinstance(nrows, bool) or not isinstance(nrows, int):
        raise TypeError("nrows must be an integer")
    if nrows <= 0:
        raise ValueError("nrows must be positive")
    text = load_raw_csv(spark, path, encoding=encoding, infer=False, **options).limit(nrows)
    rows = text.collect()
    kinds = {}
    for c in text.columns:
        held = [r[c] for r in rows if r[c] is not None]
        whole = held and all(re.fullmatch(r"[+-]?(0|[1-9]\d{0,17})", v) for v in held)
        number = held and all(re.fullmatch(r"[+-]?((0|[1-9]\d*)\.?\d*|\.\d+)([eE][+-]?\d+)?", v) for v in held)
        day = held and all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) for v in held)
        kinds[c] = "long" if whole else "double" if number else "date" if day else "string"
    return spark.createDataFrame(rows, text.schema).select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()])


def describe_columns(df: DataFrame) -> DataFrame:
    """column, inferred_dtype, non_null_preview_rows, null_preview_rows in column order, by one aggregate."""
    if not df.columns:
        raise ValueError("there are no columns to describe")
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("inferred_dtype"), F.col(f"c{i}").alias("non_null_preview_rows"), (F.col("n") - F.col(f"c{i}")).alias("null_preview_rows")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(rows))


def save_parquet(df: DataFrame, path, *, compression: str = "snappy", overwrite: bool = False, partition_cols: Sequence[str] | None = None) -> str:
    """Refuses an empty frame and, unless told otherwise, an existing target."""
    if missing := [c for c in partition_cols or () if c not in df.columns]:
        raise ValueError(f"partition columns are missing: {missing}")
    if not overwrite and exists(df.sparkSession, str(path)):
        raise FileExistsError(f"target exists: {path}")
    if df.isEmpty():
        raise ValueError("refusing to write an empty DataFrame")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(str(path))
    return str(path)


def load_parquet(spark: SparkSession, path, *, columns: Sequence[str] | None = None, filters=None) -> DataFrame:
    """Columns and a filter (a Column or SQL text) reach the scan; NaN becomes NULL, for which the filter counts again."""
    df = spark.read.parquet(str(path))
    df = without_nan(df.where(filters)).where(filters) if filters is not None else without_nan(df)
    return df.select(*columns) if columns else df


def csv_to_parquet(spark: SparkSession, csv, parquet, *, parse_dates: Sequence[str] = (), numeric_cols: Sequence[str] = (), winsorize_quantile: float | None = None, keep_cols: Sequence[str] | None = None, compression: str = "snappy", overwrite: bool = False) -> str:
    """Read once as text, with the casts that are declared and no others: 00700 stays a ticker. Numbers that aren't
    numbers raise, as do dates."""
    df = load_raw_csv(spark, csv, infer=False)
    if missing := [c for c in (*parse_dates, *numeric_cols, *(keep_cols or ())) if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    df = without_nan(df.withColumns({c: F.col(c).cast("double") for c in numeric_cols} | {c: F.to_date(F.col(c)) for c in parse_dates}))
    df = df.select(*keep_cols) if keep_cols else df
    df = winsorize_pooled(df, winsorize_quantile) if winsorize_quantile is not None else df
    return save_parquet(df, parquet, compression=compression, overwrite=overwrite)


def convert_csv_dir(spark: SparkSession, csv_dir, parquet_dir=None, *, pattern: str = "*.csv", **options) -> list[str]:
    """Each file of a folder, on any file system, on its own, in order of names; one that fails is logged and skipped."""
    source = absolute(csv_dir)
    if not is_folder(spark, source):
        raise FileNotFoundError(f"not a directory: {source}")
    target, done = absolute(parquet_dir or source), []
    for p in listed(spark, source, pattern):
        try:
            done.append(csv_to_parquet(spark, p, joined(target, f"{p.rsplit('/', 1)[1].rpartition('.')[0]}.parquet"), **options))
        except Exception as e:
            log.warning("skipped %s: %s", p, e)
    return done


def standardize_long_panel(raw: DataFrame, *, date_column: str, ticker_column: str, column_mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Date, Ticker and the other columns (renamed): dates that don't parse raise, tickers are trimmed; missing or blank
    identifiers and repeated keys are ValueErrors. Sorted by key."""
    mapping = dict(column_mapping or {})
    if missing := [c for c in (date_column, ticker_column, *mapping) if c not in raw.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if {date_column, ticker_column} & set(mapping):
        raise ValueError("identifier columns may not be renamed by column_mapping")
    others = [(c, mapping.get(c, c)) for c in raw.columns if c not in (date_column, ticker_column)]
    names = [n for _, n in others]
    if len(set(names)) < len(names) or set(names) & set(KEYS):
        raise ValueError("column_mapping makes duplicate column names")
    df = raw.select(F.to_date(F.col(date_column)).alias("Date"), F.trim(F.col(ticker_column).cast("string")).alias("Ticker"), *[F.col(c).alias(n) for c, n in others])
    bad = df.agg(F.count_if(F.col("Date").isNull()).alias("d"), F.count_if(F.coalesce("Ticker", F.lit("")) == "").alias("t")).first()
    if bad["d"] or bad["t"]:
        raise ValueError("missing dates or blank tickers")
    if not duplicate_keys(df).isEmpty():
        raise ValueError("duplicate (Date, Ticker) keys")
    return without_nan(df).orderBy(*KEYS)


def number_of(text):
    """A number, or NULL for what isn't one, such as error strings."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


#: Serial numbers up to 9999-12-31; a longer run of digits is a date without signs between.
LAST_SERIAL = 2_958_465


def excel_date(text, epoch: str = "1899-12-30"):
    """Serial numbers as days after the epoch, eight digits as year, month and day, ISO text as it says; error strings and
    what is none of these are missing."""
    days = text.try_cast("double")
    serial = F.when((days >= 0) & (days <= LAST_SERIAL), F.date_add(F.lit(epoch).cast("date"), F.floor(days).cast("int")))
    plain = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date"))
    return F.coalesce(serial, plain, text.try_cast("date"))


def pivot_descriptors(long: DataFrame, fields: Mapping[str, str], *, date: str = "date", ticker: str = "ticker", field: str = "field", value: str = "value") -> DataFrame:
    """Entity-attribute-value rows as columns: means of repeated ones, rows with nothing dropped."""
    kept = long.where(F.col(field).isin(*fields))
    wide = kept.groupBy(F.col(date).alias("Date"), F.col(ticker).alias("Ticker")).pivot(field, list(fields)).agg(F.avg(value))
    return wide.select(*KEYS, *[F.col(f"`{k}`").alias(n) for k, n in fields.items()]).dropna("all", subset=list(fields.values()))


def keyed_mean(df: DataFrame, value: str, *, date: str = "date", ticker: str = "ticker", name: str | None = None) -> DataFrame:
    """Mean for each key; keys without a value are dropped."""
    out = df.groupBy(F.col(date).alias("Date"), F.col(ticker).alias("Ticker")).agg(F.avg(value).alias(name or value))
    return out.where(F.col(name or value).isNotNull())


def contract_panel(df: DataFrame) -> DataFrame:
    """The keys and the twelve contract columns, absent ones NULL."""
    return df.select(*KEYS, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CONTRACT.items()])


def contract_schema() -> T.StructType:
    return T.StructType([T.StructField("Date", T.DateType()), T.StructField("Ticker", T.StringType()), *[T.StructField(c, T.DoubleType() if t == "double" else T.StringType()) for c, t in CONTRACT.items()]])
