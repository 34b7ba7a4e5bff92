"""Tables between the steps of a run, in the folder that driver and executors share.

A stored table cuts the lineage, survives lost executors and holds no memory; unlike a cached frame it can be measured
before a join is planned. What was stored goes by drop_stored, or else when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import _at

#: A measured side of a join is broadcast if it has at most so many numbers (8 bytes each).
BROADCAST_NUMBERS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and Spark runs in one process (tests), a temporary folder; on a cluster an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quantloom-steps/{spark.sparkContext.applicationId}"


def stored_at(df: DataFrame, what: str) -> str:
    """df as a Parquet table: where it is."""
    spark = df.sparkSession
    path, fs = _at(spark, _root(spark))
    fs.deleteOnExit(path)
    name = f"{_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    return name


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table, read again."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df, what))


def drop_at(spark: SparkSession, name: str) -> None:
    """Delete one stored table, which nothing reads any more."""
    path, fs = _at(spark, name)
    fs.delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete every table that was stored so far: no frame that reads one is of use afterwards."""
    path, fs = _at(spark, _root(spark))
    fs.delete(path, True)


def join_measured(x: DataFrame, side: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """x joined to a side with each key once, which is stored and counted first: broadcast if it is small enough, so that x
    is not shuffled, else joined as Spark sees fit."""
    held = stored(side, "statistics")
    small = held.count() * len(held.columns) <= BROADCAST_NUMBERS
    return x.join(F.broadcast(held) if small else held, list(by), how)
