"""Exact ranks inside large groups without sorting a group in one task.

``row_number() over (partition by class order by key)`` sends a whole class to
one task. When only a few ranks matter (a cap, the ends of a split, the ends
of folds), it is enough to know the key found at each of them:

1. one pass counts rows per (class, leading hex digits of the key); the counts
   give the class sizes, the sizes the wanted ranks, and accumulated counts the
   one bucket each rank falls into;
2. a second pass stores the rows of those buckets; a bucket that is still large
   is split again by its next digits, until what is left can be ranked;
3. every row compares its key with the few keys of its class.

Step 3 moves no rows at all, no step holds a class in one place, and classes,
ranks and keys are tables throughout: there may be millions of classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEED, ident
from ..workspace import broadcast_if_small, discard, materialize

# Hex digits of the key that one histogram reads: 4,096 buckets a class.
DIGITS = 3
# Rows of a bucket that one task ranks.
BUCKET_ROWS = 250_000
# File blocks whose offsets are broadcast: 128 TB of 128 MB blocks.
MAX_BLOCKS = 1_000_000
_KEY_DIGITS = 32


def seeded_key(row_id: str, seed: int = SEED) -> Column:
    """Pseudo-random but repeatable sort key of a row: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident(row_id)).cast("string")))


def key_histogram(df: DataFrame, stratum: str, row_id: str, seed: int = SEED) -> DataFrame:
    """(stratum, bucket, n): rows by the leading digits of their key, stored; rows without a stratum are left out."""
    bucket = F.substring(seeded_key(row_id, seed), 1, DIGITS)
    counted = df.where(F.col(ident(stratum)).isNotNull()).groupBy(F.col(ident(stratum)).alias("stratum"), bucket.alias("bucket"))
    return materialize(counted.agg(F.count(F.lit(1)).alias("n")), "histogram")


def stratum_sizes(histogram: DataFrame) -> DataFrame:
    """(stratum, n) of a key histogram."""
    return histogram.groupBy("stratum").agg(F.sum("n").alias("n"))


def _hits(histogram: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut, bucket, n, rank): the bucket of each wanted rank, and the rank inside it."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    found = histogram.withColumn("upto", upto).join(wanted, keys)
    found = found.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.select("stratum", "cut", "bucket", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))


def cut_keys(
    df: DataFrame, stratum: str, row_id: str, histogram: DataFrame, wanted: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(stratum, cut, key, id): the row found at each wanted 1-based rank, given as (stratum, cut, rank)."""
    keyed = df.select(F.col(ident(stratum)).alias("stratum"), seeded_key(row_id, seed).alias("key"), F.col(ident(row_id)).alias("id"))
    hits = _hits(histogram, wanted.where("rank > 0"), ["stratum"])
    # the rows of the buckets that hold a rank, once per rank
    edges = materialize(
        keyed.withColumn("bucket", F.substring("key", 1, DIGITS)).join(broadcast_if_small(hits), ["stratum", "bucket"]).drop("bucket"), "edges")
    for start in range(DIGITS, _KEY_DIGITS, DIGITS):
        if (edges.agg(F.max("n")).first()[0] or 0) <= bucket_rows:
            break
        finer = edges.withColumn("bucket", F.substring("key", start + 1, DIGITS))
        counted = finer.groupBy("stratum", "cut", "bucket").agg(F.count(F.lit(1)).alias("n"))
        within = _hits(counted, edges.select("stratum", "cut", "rank").distinct(), ["stratum", "cut"])
        before = edges
        edges = materialize(finer.drop("n", "rank").join(broadcast_if_small(within), ["stratum", "cut", "bucket"]).drop("bucket"), "edges")
        discard(before)
    place = F.row_number().over(Window.partitionBy("stratum", "cut").orderBy("key", "id"))
    return edges.withColumn("place", place).where("place = rank").select("stratum", "cut", "key", "id")


def assign_segment(
    df: DataFrame, stratum: str, row_id: str, cuts: Callable[[DataFrame], DataFrame], output: str = "segment", seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the zero-based segment of each row in its stratum's seeded order; rows without a stratum are dropped.

    ``cuts`` makes (stratum, cut, rank) from the sizes (stratum, n). Cuts are
    the ranks at which segments end: ranks 1..first cut are segment 0, the next
    ones up to the second cut are segment 1, and so on. A stratum without cuts
    is segment 0 throughout.
    """
    histogram = key_histogram(df, stratum, row_id, seed)
    wanted = materialize(cuts(stratum_sizes(histogram)).select("stratum", "cut", F.col("rank").cast("long").alias("rank")), "cuts")
    found = cut_keys(df, stratum, row_id, histogram, wanted, seed, bucket_rows)
    ends = found.groupBy("stratum").agg(F.collect_list(F.struct("key", "id")).alias("__ends"))
    # a cut at rank 0 has no row: every row of the stratum lies beyond it
    zero = wanted.groupBy("stratum").agg(F.count_if(F.col("rank") <= 0).alias("__zero"))
    table = broadcast_if_small(zero.join(ends, "stratum", "left").withColumnRenamed("stratum", "__stratum"))
    labelled = df.where(F.col(ident(stratum)).isNotNull()).withColumn("__key", seeded_key(row_id, seed))
    joined = labelled.join(table, F.col(ident(stratum)) == F.col("__stratum"), "left")
    me = F.struct(F.col("__key").alias("key"), F.col(ident(row_id)).alias("id"))
    passed = F.coalesce(F.size(F.filter("__ends", lambda e: e < me)), F.lit(0))
    passed = F.when(F.col("__ends").isNull(), 0).otherwise(passed)
    return joined.withColumn(output, (passed + F.coalesce(F.col("__zero"), F.lit(0))).cast("int")).drop("__key", "__stratum", "__ends", "__zero")


def _offsets_joined(placed: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the offset of their file or block.

    The offsets are three numbers a row, stored and counted: up to a million
    (24 MB) every task gets them whole, beyond that the join is Spark's choice.
    """
    return placed.join(broadcast_if_small(offsets, MAX_BLOCKS), keys)


def index_stored_rows(stored: DataFrame, output: str = "index") -> DataFrame:
    """Zero-based contiguous index of a Parquet table, in part and row order.

    A row's index is the size of all earlier files plus its position in its
    own file. Nothing is sorted or moved, and re-reading gives the same result.
    ``stored`` must be a direct, unfiltered scan.
    """
    path = F.col("_metadata.file_path")
    placed = stored.select("*", F.xxhash64(path).alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = stored.select(path.alias("__path")).groupBy("__path").agg(F.count(F.lit(1)).alias("__n"))
    # One row per file; longer part names come later.
    earlier = F.sum("__n").over(Window.orderBy(F.length("__path"), "__path")) - F.col("__n")
    offsets = files.select(F.xxhash64("__path").alias("__file"), earlier.alias("__before"))
    return (
        _offsets_joined(placed, offsets, ["__file"])
        .withColumn(output, F.col("__before") + F.col("__at"))
        .drop("__file", "__at", "__before")
    )


def index_by_order(df: DataFrame, order_by: list[str], output: str = "index") -> DataFrame:
    """Zero-based contiguous row index in the given order, which must be total.

    The table is written once in range-partitioned order and then indexed by
    file position, so no task needs another one's rows.
    """
    ordered = df.orderBy(*[F.col(ident(c)) for c in order_by])
    return index_stored_rows(materialize(ordered, "ordered"), output)


def index_file_rows(df: DataFrame, output: str = "index") -> DataFrame:
    """Zero-based contiguous index of a file scan in (path, position) order.

    One light pass counts the rows of each file block; a second adds the sizes
    of all earlier blocks to the position inside the block. Nothing is sorted
    or moved, whatever tasks the blocks are packed into. ``df`` must be a
    direct, unfiltered file scan: both passes then see the same blocks.
    """
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    blocks = df.select(path.alias("__path"), start.alias("__start"), F.monotonically_increasing_id().alias("__seen"))
    blocks = blocks.groupBy("__path", "__start").agg(F.min("__seen").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Two windows: inside each file, then over files, so that no single task
    # accumulates every block of the table.
    in_file = F.sum("__n").over(Window.partitionBy("__path").orderBy("__start")) - F.col("__n")
    files = blocks.groupBy("__path").agg(F.sum("__n").alias("__rows"))
    files = files.select("__path", (F.sum("__rows").over(Window.orderBy("__path")) - F.col("__rows")).alias("__before"))
    offsets = blocks.withColumn("__in_file", in_file).join(files, "__path").select(
        F.xxhash64("__path").alias("__file"), "__start", (F.col("__in_file") + F.col("__before") - F.col("__first")).alias("__offset")
    )
    placed = df.select("*", F.xxhash64(path).alias("__file"), start.alias("__start"), F.monotonically_increasing_id().alias("__seen"))
    return (
        _offsets_joined(placed, offsets, ["__file", "__start"])
        .withColumn(output, F.col("__offset") + F.col("__seen"))
        .drop("__file", "__start", "__seen", "__offset")
    )
