"""Sharding by jump consistent hashing.

A stable key goes to one of n buckets by the published jump walk (Lamping and
Veach, 2014): no ring, no table, and with one more bucket only the rows that
move into the new one change place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_rank

#: Fixed values of the published walk: the multiplier of its generator.
JUMP_MULTIPLIER = 2862933555777941757


def jump_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket in [0, n) for each unsigned 64-bit key, over whole arrays."""
    if n < 1:
        raise ValueError("there must be one shard at least")
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), dtype=np.int64)
    landing = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while live.size:
        bucket[live] = landing[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        stretch = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        landing[live] = ((bucket[live] + 1) * stretch).astype(np.int64)
        live = live[landing[live] < n]
    return bucket.astype(np.int32)


def jump_shard(key: Column, n: int) -> Column:
    """Shard of a 64-bit key column; only the keys go through Python, in batches."""

    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64).view(np.uint64), n))

    return shard(key)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """Shard and slot of every row.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law,
    shard, slot (0, 1, ... within the shard), grown_shard (with one more shard).
    A null text counts as empty, a null id is hashed as null; very long texts
    are measured whole; rows with equal ids share a shard, repeated rows too,
    and take different slots; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.xxhash64(docs[id_col]), shards).alias("shard"),
        jump_shard(F.xxhash64(docs[id_col]), shards + 1).alias("grown_shard"),
    )
    ranked = gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", buckets, [F.col("doc_id"), F.col("size")])
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
