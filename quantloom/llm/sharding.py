"""Operator 9, sharding: a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size (an offset and a step derived from its
name); shards take turns claiming their next free slot until none is left. A row's key hashes to a slot; the table, of a
fixed and checked size, is broadcast, so that placement is one hash and one lookup. Adding or removing one of n shards
moves about 1/n of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A prime; well over 100 slots a shard for a few hundred shards.
TABLE_SIZE = 65_537
#: The broadcast table has no more rows than this: 12 bytes each.
LARGEST_TABLE = 1_048_583


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard number of each slot. Slots that shards hold differ by at most one."""
    names = list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must be distinct and at least one")
    if not _prime(size) or not len(names) <= size <= LARGEST_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {LARGEST_TABLE}")
    digest = [hashlib.sha256(x.encode()).digest() for x in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    table, free = np.full(size, -1, np.int32), size
    while free:
        for i in range(len(names)):
            if not free:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    import pandas as pd

    table = lookup_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int64), "shard": table.astype(np.int64)}), "slot long, shard long")


def slot_of(*keys, size: int = TABLE_SIZE):
    """The slot of a key; a null key has the slot of its hash seed, so that it is placed as well."""
    return F.pmod(F.xxhash64(*keys), F.lit(size))


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Each row of df with its slot and shard number: no shuffle, one broadcast lookup.

    Columns of df named slot or shard are replaced. Null keys share one slot; equal keys share a shard, whatever the
    number of their rows (choose a key as fine as rows, such as an id, where one value holds a large share). An empty df
    gives no rows.
    """
    keys_in = df.drop("slot", "shard") if not {"slot", "shard"} & set(keys) else df
    slots = keys_in.withColumn("__slot", slot_of(*[F.col(k) for k in keys], size=size))
    found = F.broadcast(table_frame(df.sparkSession, shards, size).toDF("__slot", "__shard"))
    out = slots.join(found, "__slot", "left")
    kept = [c for c in keys_in.columns if c not in ("slot", "shard")]
    return out.select(*kept, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
