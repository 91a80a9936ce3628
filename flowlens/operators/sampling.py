"""Class balancing, stratified splits, subsets, folds and seeded samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import (
    HELD_OUT_SHARE, LABEL, MAX_CAP, MIN_SAMPLES, SEED, SPLIT, SPLITS, TARGET_TOTAL, TEST_SHARE_OF_HELD_OUT,
    TUNE_FOLDS, ident,
)
from .ranking import BUCKET_ROWS, assign_segment, seeded_key

_SHOWN = 20


def _total(sizes: DataFrame) -> int:
    return int(sizes.agg(F.sum("n")).first()[0] or 0)


def plan_of_sizes(sizes: DataFrame, target: int = TARGET_TOTAL, floor: int = MIN_SAMPLES, cap: int = MAX_CAP) -> DataFrame:
    """(stratum, n, cap): each stratum scaled toward the target size.

    The proportional size is rounded half-even, kept within [floor, cap] and
    never exceeds what is available.
    """
    # Runs over one row per class.
    total = F.sum("n").over(Window.partitionBy())
    wanted = F.bround(F.col("n") * (F.lit(float(target)) / total), 0).cast("long")
    limited = F.greatest(F.lit(floor).cast("long"), F.least(F.lit(cap).cast("long"), wanted))
    return sizes.withColumn("cap", F.least(F.col("n"), limited))


def balance_plan(
    df: DataFrame, label: str = LABEL,
    target: int = TARGET_TOTAL, floor: int = MIN_SAMPLES, cap: int = MAX_CAP,
) -> DataFrame:
    """(class, available, cap, sampled) of a table."""
    sizes = df.where(F.col(ident(label)).isNotNull()).groupBy(F.col(ident(label)).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    plan = plan_of_sizes(sizes, target, floor, cap)
    return plan.select(F.col("stratum").alias(label), F.col("n").alias("available"), "cap", F.col("cap").alias("sampled"))


def balanced_sample(
    df: DataFrame, row_id: str, label: str = LABEL,
    target: int = TARGET_TOTAL, floor: int = MIN_SAMPLES, cap: int = MAX_CAP,
    seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact-size sample of each class without replacement; small classes stay whole."""

    def cuts(sizes: DataFrame) -> DataFrame:
        return plan_of_sizes(sizes, target, floor, cap).where("cap < n").select("stratum", F.lit(0).alias("cut"), F.col("cap").alias("rank"))

    return assign_segment(df, label, row_id, cuts, "__segment", seed, bucket_rows).where("__segment = 0").drop("__segment")


def shuffled(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """Seeded global order. A range-partitioned sort: only for ordered artefacts."""
    return df.orderBy(seeded_key(row_id, seed), F.col(ident(row_id)))


def proportional_quota(counts: dict[str, int], draws: int) -> dict[str, int]:
    """Largest-remainder shares of ``draws`` over the strata, ties in name order.

    Integer arithmetic on one number per class, exact at any table size.
    """
    total = sum(counts.values())
    floors = {s: n * draws // total for s, n in counts.items()}
    left = draws - sum(floors.values())
    by_remainder = sorted(counts, key=lambda s: (-(counts[s] * draws % total), s))
    for s in by_remainder[:left]:
        floors[s] += 1
    return floors


def quota_table(sizes: DataFrame, total: int, draws: int, output: str = "quota") -> DataFrame:
    """``sizes`` with largest-remainder shares of ``draws`` over the strata, ties in name order; exact integers at any size."""
    product = F.col("n").cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")
    whole = F.lit(total).cast("decimal(19,0)")
    shares = sizes.withColumn("__product", product).withColumn("__total", whole)
    shares = shares.withColumn("__floor", F.expr("__product div __total")).withColumn("__rest", F.expr("__product % __total"))
    # one row per stratum
    left = F.lit(draws) - F.sum("__floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("__rest").desc(), "stratum"))
    quota = (F.col("__floor") + F.when(place <= left, 1).otherwise(0)).cast("long")
    return shares.withColumn(output, quota).drop("__product", "__total", "__floor", "__rest")


def _ceil_share(n: int, share: float) -> int:
    # Shares such as 0.2 are decimals; scale to integers so that big n stays exact.
    parts = round(share * 1_000_000)
    return -(-n * parts // 1_000_000)


def split_quotas(
    counts: dict[str, int],
    held_out: float = HELD_OUT_SHARE, test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
) -> dict[str, tuple[int, int, int]]:
    """Train, validation and test rows of each stratum.

    Totals round the held-out part up, then its test part up; each total is
    spread over the strata by largest remainder.
    """
    rare = [s for s, n in counts.items() if n < 2]
    if rare:
        raise ValueError(f"too few rows to split: {rare}")
    total = sum(counts.values())
    n_held = _ceil_share(total, held_out)
    n_test = _ceil_share(n_held, test_of_held_out)
    train = proportional_quota(counts, total - n_held)
    rest = {s: counts[s] - train[s] for s in counts}
    val = proportional_quota(rest, n_held - n_test)
    return {s: (train[s], val[s], rest[s] - val[s]) for s in counts}


def split_quota_table(
    sizes: DataFrame, held_out: float = HELD_OUT_SHARE, test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
) -> DataFrame:
    """(stratum, n, train, val): ``split_quotas`` of any number of strata; the rest of a stratum is its test part."""
    rare = [r["stratum"] for r in sizes.where("n < 2").orderBy("stratum").limit(_SHOWN).collect()]
    if rare:
        raise ValueError(f"too few rows to split, among others: {rare}")
    total = _total(sizes)
    n_held = _ceil_share(total, held_out)
    n_test = _ceil_share(n_held, test_of_held_out)
    trained = quota_table(sizes, max(1, total), total - n_held, "train")
    rest = trained.select("stratum", (F.col("n") - F.col("train")).alias("n"))
    val = quota_table(rest, max(1, n_held), n_held - n_test, "val").select("stratum", "val")
    return trained.join(val, "stratum")


def stratified_split(
    df: DataFrame, row_id: str, stratum: str = LABEL,
    held_out: float = HELD_OUT_SHARE, test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
    seed: int = SEED, output: str = SPLIT, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add a train / val / test column with exact, stratified sizes; rows without a stratum are dropped."""

    def cuts(sizes: DataFrame) -> DataFrame:
        quotas = split_quota_table(sizes, held_out, test_of_held_out)
        return quotas.select("stratum", F.posexplode(F.array("train", F.col("train") + F.col("val"))).alias("cut", "rank"))

    marked = assign_segment(df, stratum, row_id, cuts, "__segment", seed, bucket_rows)
    name = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("__segment") + 1)
    return marked.withColumn(output, name).drop("__segment")


def stratified_subset(
    df: DataFrame, row_id: str, stratum: str, rows: int,
    seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Stratified subset of a fixed total size; the whole table if it is not larger. Rows without a stratum are dropped."""

    def cuts(sizes: DataFrame) -> DataFrame:
        total = _total(sizes)
        if rows >= total:
            return sizes.select("stratum", F.lit(0).alias("cut"), F.col("n").alias("rank"))
        return quota_table(sizes, total, rows).select("stratum", F.lit(0).alias("cut"), F.col("quota").alias("rank"))

    return assign_segment(df, stratum, row_id, cuts, "__segment", seed, bucket_rows).where("__segment = 0").drop("__segment")


def fold_sizes(counts: dict[str, int], folds: int) -> dict[str, list[int]]:
    """Rows of each stratum in each fold.

    Rows lined up by stratum are dealt to the folds in turn, so both the folds
    and each stratum's part of them differ by at most one row.
    """
    sizes, start = {}, 0
    for s, n in counts.items():
        sizes[s] = [len(range((f - start) % folds, n, folds)) for f in range(folds)]
        start += n
    return sizes


def fold_table(sizes: DataFrame, folds: int) -> DataFrame:
    """(stratum, cut, rank): where the folds of each stratum end, as ``fold_sizes`` deals them."""
    start = F.sum("n").over(Window.orderBy("stratum")) - F.col("n")
    placed = sizes.withColumn("__start", start)
    upto, ends = F.lit(0).cast("long"), []
    for f in range(folds - 1):
        first = F.pmod(F.lit(f) - F.col("__start"), F.lit(folds))
        upto = upto + F.floor((F.greatest(F.col("n") - first, F.lit(0)) + folds - 1) / folds)
        ends.append(upto)
    return placed.select("stratum", F.posexplode(F.array(*ends)).alias("cut", "rank"))


def stratified_folds(
    df: DataFrame, row_id: str, stratum: str, folds: int = TUNE_FOLDS,
    seed: int = SEED, output: str = "fold", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add a zero-based fold number, shuffled inside each stratum; rows without a stratum are dropped."""
    return assign_segment(df, stratum, row_id, lambda sizes: fold_table(sizes, folds), output, seed, bucket_rows)


def seeded_sample(df: DataFrame, row_id: str, rows: int, seed: int = SEED) -> DataFrame:
    """Uniform sample of a few rows without replacement, in row order.

    A distributed top-n on the seeded key, then a sort of the few rows.
    """
    return (
        df.withColumn("__key", seeded_key(row_id, seed))
        .orderBy("__key", F.col(ident(row_id))).limit(rows)
        .drop("__key").orderBy(F.col(ident(row_id)))
    )
