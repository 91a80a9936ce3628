"""Shards by jump consistent hashing: no ring table, and an appended shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ranked
from .words import mix

_NULL_KEY = 0x6E756C6C


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key.

    Every key jumps ahead through the shard counts at which it would move; the
    last jump below ``shards`` is its place.  About ln(shards) rounds, each on
    the keys that still jump.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mix(np.asarray(keys).astype(np.int64).view(np.uint64))
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    ahead = at.copy()
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = np.floor((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(column: str, shards: int):
    """Column of shards by an integer key; rows without a key share one."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return place(F.coalesce(F.col(column).cast("bigint"), F.lit(_NULL_KEY)))


def sharded(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every document.

    size: UTF-8 bytes and 8 for the length (null text: 8, crc of nothing); slot:
    place in the shard in the order of id, crc and size; grown_shard: the shard
    with one shard more.  Equal ids go to one shard, whatever their texts.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(id_column, shards).alias("shard"), shard_of(id_column, shards + 1).alias("grown_shard"),
    )
    return ranked(rows, "shard", ["id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write documents to one folder per shard; ``files_per_shard`` tasks share a shard."""
    placed = docs.withColumn("shard", shard_of(id_column, shards))
    salt = F.pmod(F.xxhash64(F.col(id_column)), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
