"""How five document filters act together, in every order.

A: too few words; B: too few different words; C: too many capitals; D: a
listed character; E: the same text as a document of smaller id.  All but E
depend on the text alone.  For E a counting Bloom sketch of text hashes is
filled per partition and merged by block: a text with a cell that counted one
row is certainly unique.  Only the texts that may repeat are shuffled, whole,
for the least id of each.  Rows are then counted by the set of filters they
fail, and every order's counts are sums over these sets.

Defined results: a null text is empty; two null texts are equal.  A row
without id never fails E and makes no other row fail it; rows that share their
id and text do not make each other fail.  Labels: the larger one where a
document has several, none counts as 0.  A null part is the empty string.  An
empty table gives no row.  Texts may have any length, rows may repeat; other
columns are not read, so their names do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..workspace import discard, materialize

FILTERS = "ABCDE"
MIN_WORDS = 50
LEAST_DIFFERENT = 65  # of 100 words
MOST_CAPITALS = 5  # of 100 characters
LISTED = "[#$%&*|]"
#: A block has so many cells and is filled by about so many rows; each row sets _CELLS_A_ROW cells of one block.
_BLOCK_CELLS = 1 << 16
_BLOCK_ROWS = 1 << 12
_CELLS_A_ROW = 3
#: Blocks of a part of the sketch that a task holds at once: 4,096 blocks are 64 MB and stand for 16 million rows.
PART_BLOCKS = 1 << 12
_SIGNATURES = 1 << 16


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The cells of each hash in its block, a row each."""
    h = hashes.astype(np.uint64)
    return np.stack([((h >> np.uint64(16 * k)) & np.uint64(_BLOCK_CELLS - 1)).astype(np.int64) for k in range(_CELLS_A_ROW)], axis=1)


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % blocks


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells that counted once and cells that counted more often, two bitmaps."""
    once, more = np.zeros(_BLOCK_CELLS, dtype=bool), np.zeros(_BLOCK_CELLS, dtype=bool)
    once[cells[counts == 1]] = True
    more[cells[counts > 1]] = True
    return np.packbits(once).tobytes() + np.packbits(more).tobytes()


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, cells): the merged counting sketch of a column of 64-bit hashes, counters held at two."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a task that set a cell, as (block, cell) -> 1 or 2; no larger than the task's share of hashes
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([held[0], *waiting])
            counts = np.concatenate([held[1], np.ones(len(keys) - len(held[0]), np.int64)])
            keys, place = np.unique(keys, return_inverse=True)
            return keys, np.minimum(np.bincount(place, weights=counts, minlength=len(keys)), 2).astype(np.int64)

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            # a row sets each of its cells once
            keys = _block_of(h, blocks)[:, None] * _BLOCK_CELLS + np.sort(_cells(h), axis=1)
            first = np.concatenate([np.ones((len(h), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
            waiting.append(keys[first])
            if sum(map(len, waiting)) > _SIGNATURES * 16:
                held, waiting = merged(), []
        keys, counts = merged()
        for at in range(0, len(keys), _SIGNATURES):
            k = keys[at : at + _SIGNATURES]
            number = k // _BLOCK_CELLS
            edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
            codes = ((k % _BLOCK_CELLS) * 2 + counts[at : at + _SIGNATURES] - 1).astype("<u4")
            rows = [(int(number[a]), codes[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "codes"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BLOCK_CELLS, np.int64)
        for part in parts:
            for codes in part.column(part.schema.get_field_index("codes")):
                values = np.frombuffer(codes.as_py(), dtype="<u4").astype(np.int64)
                total[values >> 1] += (values & 1) + 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([_packed(used, total[used])], pa.binary())], ["block", "cells"])

    partial = StructType([StructField("block", LongType()), StructField("codes", BinaryType())])
    whole = StructType([StructField("block", LongType()), StructField("cells", BinaryType())])
    return hashes.mapInArrow(fill, partial).groupBy("block").applyInArrow(merge, whole)


def _may_repeat(rows: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``__repeats``: false where the sketch proves that no other row has the hash ``__h``.

    The sketch goes to the tasks in parts of a proven size; a further part
    looks only at rows that are still open.
    """
    spark = rows.sparkSession
    for first in range(0, blocks, PART_BLOCKS):
        part = cells.where((F.col("block") >= first) & (F.col("block") < first + PART_BLOCKS)).orderBy("block").toArrow()
        shared = spark.sparkContext.broadcast((part["block"].to_numpy(), b"".join(part["cells"].to_pylist())))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            numbers, data = shared.value
            places = np.full(PART_BLOCKS, -1, np.int64)
            places[numbers - first] = np.arange(len(numbers))
            more = np.frombuffer(data, np.uint8).reshape(len(numbers), 2, _BLOCK_CELLS // 8)[:, 1] if len(numbers) else None
            for batch in batches:
                h = batch.column(batch.schema.get_field_index("__h")).to_numpy(zero_copy_only=False)
                block = _block_of(h, blocks) - first
                mine = np.flatnonzero((block >= 0) & (block < PART_BLOCKS))
                at = batch.schema.get_field_index("__repeats")
                out = batch.column(at).to_numpy(zero_copy_only=False).copy()
                if len(mine):
                    cell = _cells(h[mine])
                    bits = more[places[block[mine]][:, None], cell >> 3] >> (7 - (cell & 7)) & 1
                    out[mine] = bits.all(axis=1)
                columns = list(batch.columns)
                columns[at] = pa.array(out)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = rows.mapInArrow(look, rows.schema)
    return rows


def failures(text: Column) -> Column:
    """Which of the filters A to D a text fails, as bits 0 to 3."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(spaced, " "), "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DIFFERENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(LISTED),
    ]
    total = F.lit(0)
    for bit, failed in enumerate(fails):
        total = total + F.when(failed, 1 << bit).otherwise(0)
    return total.cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail, bit k for the k-th letter."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("__id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("__text"),
        F.xxhash64(text).alias("__h"), F.xxhash64(text, F.lit(1)).alias("__h2"), F.lit(True).alias("__repeats"),
    ).withColumn("mask", failures(F.col("__text")))
    blocks = max(1, -(-docs.count() // _BLOCK_ROWS))
    cells = materialize(sketch(rows.select("__h"), blocks), "sketch")
    judged = _may_repeat(rows, cells, blocks)
    # whole texts go on for possible repeats only
    flagged = materialize(judged.withColumn("__text", F.when(F.col("__repeats") & F.col("__id").isNotNull(), F.col("__text"))), "masks")
    discard(cells)

    doubtful = flagged.where(F.col("__text").isNotNull())
    least = doubtful.groupBy("__text").agg(F.min("__id").alias("__id"), F.first("__h").alias("__h"), F.first("__h2").alias("__h2"))
    least = least.select("__id", "__h", "__h2", F.lit(True).alias("__least"))
    # a row's own id and two hashes: one key for a row, however many rows share its text
    repeated = doubtful.drop("__text").join(least, ["__id", "__h", "__h2"], "left")
    repeated = repeated.withColumn("mask", F.when(F.col("__least"), F.col("mask")).otherwise(F.col("mask") + 16))
    single = flagged.where(F.col("__text").isNull())

    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("__id"))
    known = known.agg(F.max(F.col("quality")).alias("__good"), F.max(F.col("toxic")).alias("__toxic"))
    with_id = single.where(F.col("__id").isNotNull()).select("__id", "part", "mask").unionByName(repeated.select("__id", "part", "mask"))
    without = single.where(F.col("__id").isNull()).select("part", "mask", F.lit(None).alias("__good"), F.lit(None).alias("__toxic"))
    every = with_id.join(known, "__id", "left").select("part", "mask", "__good", "__toxic").unionByName(without)
    return every.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if(F.col("__good") == 1).alias("good"), F.count_if(F.col("__toxic") == 1).alias("toxic")
    )


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter of each order does, from counts by failed set: sums over at most 32 sets a part."""
    every = list(range(1 << len(FILTERS)))

    def at(column: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(column))), F.lit(0)) for m in every]).alias(f"__{column}")

    parts = counts.groupBy("part").agg(at("n"), at("good"), at("toxic"))
    steps = []
    for letters in itertools.permutations(FILTERS):
        before = 0
        for k, letter in enumerate(letters):
            bit = 1 << FILTERS.index(letter)
            steps.append(F.struct(F.lit("".join(letters)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")))
            before |= bit
    rows = parts.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")

    def total(column: str, wanted) -> Column:
        """Sum of the sets for which ``wanted`` holds."""
        kept = F.transform(F.col(f"__{column}"), lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0)))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b)

    before, bit = F.col("before"), F.col("bit")
    fails = lambda m: m.bitwiseAND(bit) != 0
    open_ = lambda m: m.bitwiseAND(before) == 0
    # a set of k filters is removed by each of them in 120 / k orders
    share = F.aggregate(
        F.transform(F.col("__n"), lambda n, m: F.when(fails(m), n * F.floor(F.lit(120) / F.bit_count(m))).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & open_(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~open_(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & open_(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & open_(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    return interactions(mask_counts(docs, labels, id_column, text_column, part_column))
