"""Exact column medians by radix selection.

A double becomes a 64-bit key whose unsigned order is the order of the values.
Four passes read 16 bits each: a pass counts, for all columns at once, the
values that begin with the bits found so far by their next 16 bits, and the
counts up to a bucket tell which one holds the wanted rank. The same four
passes serve any number of rows; a column with an even number of values has
two ranks to find, which share their passes.

Tasks count into dense arrays; there are at most as many of them as the cluster
runs at once, so the counts that are shuffled grow with its cores, not with
the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schema import ident
from ..workspace import discard, materialize

_BITS = 16
_BUCKETS = 1 << _BITS
_SIGN = np.uint64(1 << 63)


def column_summary(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Finite-value count, minimum and maximum of each column, and the row count, in one pass."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        value = finite(F.col(ident(name)))
        aggregates += [
            F.count(value).alias(f"n{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
        ]
    row = df.agg(*aggregates).first()
    return {
        name: {"rows": row["rows"], "values": row[f"n{i}"], "min": row[f"min{i}"], "max": row[f"max{i}"]}
        for i, name in enumerate(columns)
    }


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the values; both zeros have one key."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def key_value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _histograms(stored: DataFrame, wanted: list[tuple[int, int]], level: int) -> DataFrame:
    """(slot, bucket, n): the next 16 bits of the values that begin with the slot's bits; slots are (column, bits)."""
    shift = np.uint64(64 - _BITS * (level + 1))
    used = sorted({c for c, _ in wanted})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(_BUCKETS, dtype=np.int64) for i in range(len(wanted))}
        for batch in batches:
            for place, column in enumerate(used):
                keys = order_keys(batch.column(place).drop_null().to_numpy(zero_copy_only=False))
                for slot, (c, start) in enumerate(wanted):
                    if c == column:
                        inside = keys if level == 0 else keys[keys >> (shift + np.uint64(_BITS)) == np.uint64(start)]
                        totals[slot] += np.bincount((inside >> shift & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS)
        for slot, total in totals.items():
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), slot, dtype=np.int32)), pa.array(held.astype(np.int32)), pa.array(total[held])], ["slot", "bucket", "n"])

    tasks = stored.select(*[f"v{c}" for c in used]).coalesce(stored.sparkSession.sparkContext.defaultParallelism)
    return tasks.mapInArrow(count, "slot int, bucket int, n long").groupBy("slot", "bucket").agg(F.sum("n").alias("n"))


def column_medians(df: DataFrame, columns: list[str], summary: dict[str, dict] | None = None) -> dict[str, float | None]:
    """Exact median of the finite values of each column; None if there are none.

    The columns are stored once and read by every pass.
    """
    if not columns:
        return {}
    stored = materialize(df.select(*[finite(F.col(ident(c)).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]), "columns")
    summary = summary or column_summary(df, columns)
    # (column, rank) -> bits found so far and the rank among the values that begin with them
    found = {}
    for i, name in enumerate(columns):
        n = summary[name]["values"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            found[i, rank] = (0, rank)
    for level in range(64 // _BITS) if found else ():
        wanted = sorted({(column, bits) for (column, _), (bits, _) in found.items()})
        slots = {w: i for i, w in enumerate(wanted)}
        ranks = df.sparkSession.createDataFrame(
            [(slots[column, bits], column, rank, inside) for (column, rank), (bits, inside) in found.items()], "slot int, column int, rank long, inside long")
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("bucket"))
        # two ranks a column: a few rows, whatever is counted
        hits = _histograms(stored, wanted, level).withColumn("upto", upto).join(F.broadcast(ranks), "slot")
        hits = hits.where((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside")))
        for h in hits.select("column", "rank", "bucket", (F.col("inside") - F.col("upto") + F.col("n")).alias("inside")).collect():
            bits, _ = found[h["column"], h["rank"]]
            found[h["column"], h["rank"]] = (bits << _BITS | h["bucket"], h["inside"])
    discard(stored)
    values: dict[str, list[float]] = {c: [] for c in columns}
    for (column, _), (bits, _) in sorted(found.items()):
        values[columns[column]].append(key_value(bits))
    return {c: sum(v) / len(v) if v else None for c, v in values.items()}
