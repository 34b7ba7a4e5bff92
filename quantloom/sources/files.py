"""Small files and whole tables on any file system that Spark reaches, each there as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def joined(folder, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}"


def _beside(path, mark: str) -> str:
    folder, _, name = str(path).rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{mark}-{uuid.uuid4().hex}" if folder else f".{name}.{mark}-{uuid.uuid4().hex}"


def _take_place(spark: SparkSession, part: str, path, overwrite: bool) -> None:
    """part gets the name; what had it goes once that is done."""
    p, fs = _at(spark, path)
    old = None
    if fs.exists(p):
        if not overwrite:
            fs.delete(_at(spark, part)[0], True)
            raise FileExistsError(f"there is something at {path}")
        old = _at(spark, _beside(path, "old"))[0]
        fs.rename(p, old)
    if not fs.rename(_at(spark, part)[0], p):
        raise OSError(f"could not give the name {path}")
    if old is not None:
        fs.delete(old, True)


def write_text(spark: SparkSession, path, text: str, *, overwrite: bool = False) -> str:
    part = _beside(path, "part")
    p, fs = _at(spark, part)
    fs.mkdirs(_at(spark, path)[0].getParent() or _at(spark, ".")[0])
    out = fs.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _take_place(spark, part, path, overwrite)
    return str(path)


def read_text(spark: SparkSession, path) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"there is no file at {path}")
    return spark.read.text(str(path), wholetext=True).first()[0]


def write_json(spark: SparkSession, path, content: dict, *, overwrite: bool = False) -> str:
    return write_text(spark, path, json.dumps(content, allow_nan=False, sort_keys=True, indent=1), overwrite=overwrite)


def write_whole(df: DataFrame, path, *, kind: str = "parquet", overwrite: bool = False, **options) -> str:
    """Written beside the target, then renamed: readers never see a part."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        raise FileExistsError(f"there is something at {path}")
    part = _beside(path, "part")
    df.write.options(**options).format(kind).save(part)
    _take_place(spark, part, path, overwrite)
    return str(path)


def absolute(path) -> str:
    """The path with ~ expanded; one without a scheme is of this machine's file system, as an absolute path."""
    from pathlib import Path

    return str(path) if "://" in str(path) or str(path).startswith("file:") else str(Path(path).expanduser().absolute())


def is_folder(spark: SparkSession, path) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listed(spark: SparkSession, folder, pattern: str) -> list[str]:
    """The files (or folders) right in a folder whose names fit the pattern, in order of names."""
    p, fs = _at(spark, joined(folder, pattern))
    found = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in found) if found is not None else []


def put_file(spark: SparkSession, local, path, *, overwrite: bool = False) -> str:
    """A file of this machine's to any path, whole or not at all."""
    part = _beside(path, "part")
    p, fs = _at(spark, part)
    fs.copyFromLocalFile(False, True, _at(spark, f"file://{local}")[0], p)
    _take_place(spark, part, path, overwrite)
    return str(path)
