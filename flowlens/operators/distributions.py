"""Class counts and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import percent, share
from ..schema import FAMILY_LABEL, LABEL, SPLIT, ident


def class_counts(df: DataFrame, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    """Rows per class (and group). Partial counts run before the shuffle, so a
    class that fills most of the table costs no more than a rare one."""
    keys = [F.col(ident(c)) for c in (by or [])]
    return df.groupBy(*keys, F.col(ident(label))).agg(F.count(F.lit(1)).alias("rows"))


def _shares(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = F.sum("rows").over(Window.partitionBy(*(by or [])))
    return counts.withColumn("total", total)


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count, percentage and table total of each class, in class order."""
    return (
        _shares(class_counts(df, label))
        .withColumn("pct", percent(F.col("rows"), F.col("total")))
        .orderBy(F.col(ident(label)))
    )


def family_distribution(df: DataFrame, family: str = FAMILY_LABEL) -> DataFrame:
    """Count and percentage of each family, largest first."""
    return (
        _shares(class_counts(df, family))
        .select(family, "rows", percent(F.col("rows"), F.col("total")).alias("pct"))
        .orderBy(F.col("rows").desc(), family)
    )


def class_shares(df: DataFrame, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    """Share of each class in the table, or in each group."""
    by = by or []
    counted = _shares(class_counts(df, label, by), by)
    return counted.withColumn("share", share(F.col("rows"), F.col("total"))).drop("total")


def split_sizes(df: DataFrame, split: str = SPLIT) -> DataFrame:
    counted = _shares(class_counts(df, split))
    return counted.select(split, "rows", percent(F.col("rows"), F.col("total")).alias("pct"))


def max_share_difference(
    left: DataFrame, right: DataFrame, label: str = LABEL, tolerance: float | None = None,
) -> DataFrame:
    """Largest absolute difference of class shares between two tables.

    Classes found in only one of them are ignored.
    """
    return share_gap(class_shares(left, label), class_shares(right, label), label, tolerance)


def aligned_shares(left: DataFrame, right: DataFrame, label: str = LABEL) -> DataFrame:
    """Class-aligned shares of two distributions and their absolute difference."""
    a = left.select(F.col(ident(label)), F.col("share").alias("left_share"))
    b = right.select(F.col(ident(label)), F.col("share").alias("right_share"))
    return a.join(b, label).withColumn("difference", F.abs(F.col("left_share") - F.col("right_share")))


def share_gap(left: DataFrame, right: DataFrame, label: str = LABEL, tolerance: float | None = None) -> DataFrame:
    gap = aligned_shares(left, right, label).agg(F.max("difference").alias("max_difference"))
    if tolerance is not None:
        gap = gap.withColumn("passed", F.col("max_difference") <= tolerance)
    return gap
