"""Summaries and health of a scored batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_attack
from ..functions.numeric import finite, percent, share
from ..schema import BENIGN_FAMILY, SHIFT_TOLERANCE, ident
from .distributions import class_shares

# Health limits: share of attack rows and number of attack types.
CRITICAL_SHARE = 0.80
WARNING_SHARE = 0.30
DIVERSE_TYPES = 5
FEATURE_SHIFT_LIMIT = 3.0


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Totals, attack share and mean confidences of a coarse scored batch.

    The mean attack confidence covers attack rows only; null without any.
    """
    attack = F.col("binary_prediction") != BENIGN_FAMILY
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(attack).alias("attacks"),
        F.count_if(~attack).alias("benign"),
        F.avg("confidence_binary").alias("mean_binary_confidence"),
        F.avg(F.when(attack, F.col("confidence_attack"))).alias("mean_attack_confidence"),
    ).withColumn("attack_pct", percent(F.col("attacks"), F.col("total")))


def binary_distribution(scored: DataFrame) -> DataFrame:
    """Attack and benign rows, percentage, and width against the larger of both."""
    attack = F.col("binary_prediction") != BENIGN_FAMILY
    counted = scored.agg(F.count_if(attack).alias("a"), F.count_if(~attack).alias("b"))
    larger = F.greatest("a", "b")
    total = F.col("a") + F.col("b")
    rows = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("Attack").alias("class"), F.col("a").alias("rows")),
        F.struct(F.lit(2).alias("rank"), F.lit("Benign").alias("class"), F.col("b").alias("rows")),
    )
    return counted.select(total.alias("total"), larger.alias("larger"), F.inline(rows)).select(
        "rank", "class", "rows",
        percent(F.col("rows"), F.col("total")).alias("pct"), percent(F.col("rows"), F.col("larger")).alias("width"),
    )


def ranked_classes(scored: DataFrame, label: str, confidence: str, index: str = "index") -> DataFrame:
    """Count, share, mean confidence and rank per class, largest first.

    Classes of equal size keep the order of their first row.
    """
    grouped = scored.groupBy(F.col(ident(label)).alias("class")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(confidence).alias("mean_confidence"), F.min(index).alias("first_index"),
    )
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("rows").desc(), "first_index"))
    return grouped.select(
        "class", "rows", "mean_confidence", rank.alias("rank"),
        percent(F.col("rows"), F.sum("rows").over(everything)).alias("pct"),
        percent(F.col("rows"), F.max("rows").over(everything)).alias("width"),
    )


def family_predictions(scored: DataFrame, index: str = "index") -> DataFrame:
    known = scored.withColumn("attack_family", F.coalesce("attack_family", F.lit("Unknown")))
    return ranked_classes(known, "attack_family", "confidence_attack", index)


def class_predictions(scored: DataFrame) -> DataFrame:
    """Rows and share of each predicted fine class."""
    counted = class_shares(scored, "predicted_class")
    return counted.withColumn("pct", F.col("share") * 100).drop("share")


def health_status(attack_share: Column, attack_types: Column) -> Column:
    """Critical, Warning or Stable; null for an empty batch."""
    return (
        F.when(attack_share.isNull(), None)
        .when(attack_share > CRITICAL_SHARE, "Critical")
        .when((attack_share > WARNING_SHARE) & (attack_types >= DIVERSE_TYPES), "Critical")
        .when(attack_share <= WARNING_SHARE, "Stable")
        .otherwise("Warning")
    )


def health(scored: DataFrame, label: str = "predicted_class", by: list | None = None) -> DataFrame:
    """Rows, attacks, attack share, attack types and status, per group if given.

    Counts first per class and then over classes: both steps combine on the
    map side and the number of types is exact without a distinct on rows.
    """
    by = by or []
    per_class = scored.groupBy(*by, F.col(ident(label)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    attack = is_attack(F.col("class"))
    totals = per_class.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("attacks"),
        F.count_if(attack).alias("attack_types"),
    )
    ratio = share(F.col("attacks"), F.col("rows"))
    return totals.withColumn("attack_share", ratio).withColumn(
        "status", health_status(F.col("attack_share"), F.col("attack_types"))
    )


def class_drift(batch: DataFrame, training_shares: DataFrame, label: str, tolerance: float = SHIFT_TOLERANCE) -> DataFrame:
    """Per class: share in the batch, share in training, difference and alert.

    A class that only one side has counts as share 0 on the other, and alerts.
    """
    now = class_shares(batch, label).select(F.col(ident(label)).alias("class"), F.col("share").alias("batch_share"))
    then = training_shares.select(F.col(ident(label)).alias("class"), F.col("share").alias("training_share"))
    both = now.join(then, "class", "full").withColumn("one_sided", F.col("batch_share").isNull() | F.col("training_share").isNull())
    both = both.fillna(0.0, ["batch_share", "training_share"]).withColumn("difference", F.abs(F.col("batch_share") - F.col("training_share")))
    return both.withColumn("alert", F.col("one_sided") | (F.col("difference") > tolerance)).drop("one_sided")


def feature_drift(batch: DataFrame, scaler: dict[str, tuple[float, float]], limit: float = FEATURE_SHIFT_LIMIT) -> DataFrame:
    """Shift of each feature's batch mean in training deviations; one pass."""
    names = list(scaler)
    wide = batch.agg(*[F.avg(finite(F.col(ident(c)))).alias(f"m{i}") for i, c in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"m{i}") - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias("shift"))
        for i, c in enumerate(names)
    ])
    return wide.select(F.inline(rows)).withColumn("alert", F.col("shift") > limit)
