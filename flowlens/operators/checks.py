"""Checks on prepared splits. Each returns a small table, nothing is printed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL, SHIFT_TOLERANCE, SIZE_RATIO_RANGE, SPLIT, SPLITS, TARGET_TOTAL, ident
from .cleaning import cell_profile
from .distributions import class_shares, share_gap


def missing_classes(df: DataFrame, classes: list[str], label: str = LABEL, split: str = SPLIT) -> DataFrame:
    """(split, class) pairs that have no row: all pairs minus the observed ones."""
    spark = df.sparkSession
    expected = spark.createDataFrame([(s, c) for s in SPLITS for c in classes], f"`{split}` string, `{label}` string")
    observed = df.select(F.col(ident(split)), F.col(ident(label))).distinct()
    return expected.join(observed, [split, label], "left_anti")


def class_presence(df: DataFrame, classes: list[str], label: str = LABEL, split: str = SPLIT) -> DataFrame:
    """Classes present per split and the names of the missing ones."""
    spark = df.sparkSession
    missing = missing_classes(df, classes, label, split).groupBy(split).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(ident(label)))), ",").alias("missing_names"),
        F.count(F.lit(1)).alias("missing"),
    )
    splits = spark.createDataFrame([(s,) for s in SPLITS], f"`{split}` string")
    return splits.join(missing, split, "left").select(
        split,
        (F.lit(len(classes)) - F.coalesce(F.col("missing"), F.lit(0))).cast("long").alias("present"),
        F.lit(len(classes)).cast("long").alias("expected"),
        F.coalesce(F.col("missing_names"), F.lit("")).alias("missing_names"),
    )


def size_ratio(df: DataFrame, target: int = TARGET_TOTAL, allowed: tuple[float, float] = SIZE_RATIO_RANGE) -> DataFrame:
    ratio = F.col("rows") / F.lit(float(target))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", ratio.alias("ratio"),
        F.when(ratio.between(*allowed), "PASS").otherwise("WARN").alias("verdict"),
    )


def split_shift(df: DataFrame, label: str = LABEL, split: str = SPLIT, tolerance: float = SHIFT_TOLERANCE) -> DataFrame:
    """Largest class-share difference between train and validation, from one scan."""
    shares = class_shares(df, label, [split])
    train = shares.where(F.col(ident(split)) == "train")
    val = shares.where(F.col(ident(split)) == "val")
    return share_gap(train, val, label, tolerance)


def clean_splits(df: DataFrame, features: list[str], split: str = SPLIT) -> DataFrame:
    """Null and infinite cells per split and whether the split passes."""
    return cell_profile(df, features, [split]).groupBy(split).agg(
        F.sum("nulls").alias("nulls"), F.sum("infs").alias("infs"),
        (F.sum(F.col("nulls") + F.col("infs")) == 0).alias("passed"),
    )


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
