"""Minimal perfect hashing of 64-bit keys, built in Spark shard by shard.

A shard holds the keys of one range of hashes.  Level by level its open keys
are hashed into a bitmap twice as long; a key alone in its place is settled
and its bit set, the others go on to the next level.  A key's number is the
count of set bits before its own over all shards, so the numbers of n keys are
0 to n - 1 and a table needs about four bits a key.  The keys themselves, in
the order of their numbers, tell a known key from any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .words import mix

SHARD_KEYS = 1 << 15
_ROOM = 2


def _seed(level: int) -> np.uint64:
    return mix(np.array([level + 1], dtype=np.uint64))[0]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def settle(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each level, all bitmaps in a row, keys in the order of their bits) of different keys."""
    keys = keys.astype(np.uint64)
    sizes, maps, settled = [], [], []
    while len(keys):
        size = -(-_ROOM * len(keys) // 64) * 64
        place = (mix(keys ^ _seed(len(sizes))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[place[alone]] = 1
        maps.append(np.packbits(bits, bitorder="little").tobytes())
        settled.append(keys[alone][np.argsort(place[alone])])
        sizes.append(size)
        keys = keys[~alone]
    return sizes, b"".join(maps), np.concatenate(settled) if settled else keys


def shards(keys: DataFrame, number: int) -> DataFrame:
    """(shard, sizes, bits, keys) of a table of different long keys, column ``key``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard_of(values, number).astype(np.int32))], ["key", "shard"])

    def build(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([p.column(p.schema.get_field_index("key")).to_numpy(zero_copy_only=False) for p in parts])
        sizes, bits, order = settle(found)
        columns = [pa.array([key[0].as_py()], pa.int32())]
        columns += [pa.array([x], pa.binary()) for x in (np.array(sizes, dtype="<i8").tobytes(), bits, order.astype("<u8").tobytes())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "sizes", "bits", "keys"])

    placed = keys.select("key").mapInArrow(place, StructType([*keys.select("key").schema.fields, StructField("shard", IntegerType())]))
    schema = StructType([StructField("shard", IntegerType()), *[StructField(c, BinaryType()) for c in ("sizes", "bits", "keys")]])
    return placed.groupBy("shard").applyInArrow(build, schema)


class PerfectHash:
    """Numbers of the keys of consecutive shards ``first`` to ``first + count - 1`` of ``number``."""

    def __init__(self, rows: pa.Table, number: int, first: int, count: int):
        self.number, self.first, self.count = number, first, count
        rows = rows.sort_by("shard")
        places = rows["shard"].to_numpy() - first
        sizes = [np.frombuffer(x, dtype="<i8") for x in rows["sizes"].to_pylist()]
        levels = max(map(len, sizes), default=0)
        self.size = np.zeros((count, levels), dtype=np.int64)
        self.start = np.zeros((count, levels), dtype=np.int64)
        at = 0
        for place, row in zip(places, sizes):
            self.size[place, : len(row)] = row
            self.start[place, : len(row)] = at + np.concatenate([[0], np.cumsum(row)[:-1]])
            at += int(row.sum())
        self.words = np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype="<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype="<u8")

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where the key is not among those of these shards."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        shard = shard_of(keys, self.number) - self.first
        rest = np.flatnonzero((shard >= 0) & (shard < self.count))
        for level in range(self.size.shape[1]):
            size = self.size[shard[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            if not len(rest):
                break
            place = self.start[shard[rest], level] + (mix(keys[rest] ^ _seed(level)) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(below[hit])
            rest = rest[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def chunked(keys: DataFrame, number: int, per_slice: int) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of shards that hold some ``per_slice`` keys together."""
    step = max(1, per_slice // SHARD_KEYS)
    for first in range(0, number, step):
        yield first, min(step, number - first)


def number_of_shards(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def shard_column(first: int, count: int):
    return (F.col("shard") >= first) & (F.col("shard") < first + count)
