"""Classification metrics from one count per (group, truth, prediction).

The data is aggregated once to a confusion table of at most classes x classes
rows per group; every metric is arithmetic on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import percent, share, zero_if_null
from ..schema import LABEL, OVERFIT_GAP, SPLIT, WEIGHT_CLIP, ident
from ..workspace import broadcast_if_small

METRICS = ["accuracy", "precision", "recall", "f1"]


def confusion_counts(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Long confusion matrix: (group, truth, predicted, n)."""
    keys = [F.col(ident(c)) for c in (by or [])]
    return df.groupBy(*keys, F.col(ident(truth)).alias("truth"), F.col(ident(predicted)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """Wide confusion matrix over a fixed class list, zeros where nothing fell."""
    counts = confusion_counts(df, truth, predicted).where(F.col("predicted").isin(classes))
    wide = counts.groupBy("truth").pivot("predicted", classes).agg(F.sum("n"))
    rows = df.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    return rows.join(wide, "truth", "left").na.fill(0)


def confusion_shares(counts: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Each cell as a fraction and a percentage of its truth row."""
    row_total = F.sum("n").over(Window.partitionBy(*(by or []), "truth"))
    pct = percent(F.col("n"), row_total)
    return counts.withColumn("fraction", share(F.col("n"), row_total)).withColumn(
        "pct", pct if digits is None else F.round(pct, digits)
    )


def class_report(counts: DataFrame, by: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; empty denominators give 0.

    Without ``classes`` the report covers labels seen as truth or prediction;
    with it exactly the listed ones.
    """
    by = by or []
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted_n"), F.lit(0).cast("long").alias("hits")),
    )
    totals = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"), F.sum("hits").alias("hits"),
    )
    if classes is not None:
        listed = counts.sparkSession.createDataFrame([(c,) for c in classes], "class string")
        if by:
            groups = counts.select(*by).distinct()
            listed = groups.select(*by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
        totals = listed.join(totals, [*by, "class"], "left").na.fill(0, ["support", "predicted_n", "hits"])
    return totals.select(
        *by, "class",
        zero_if_null(share(F.col("hits"), F.col("predicted_n"))).alias("precision"),
        zero_if_null(share(F.col("hits"), F.col("support"))).alias("recall"),
        zero_if_null(share(2 * F.col("hits"), F.col("support") + F.col("predicted_n"))).alias("f1"),
        "support", "hits",
    )


def summary_metrics(counts: DataFrame, by: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision / recall / F1 and weighted F1 of each group."""
    report = class_report(counts, by, classes)
    return report.groupBy(*(by or [])).agg(
        share(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def metrics_by_split(df: DataFrame, truth: str, predicted: str, split: str = SPLIT) -> DataFrame:
    return summary_metrics(confusion_counts(df, truth, predicted, [split]), [split])


SPLIT_TITLES = {"train": "Train", "val": "Validation", "test": "Test"}


def metrics_table(by_split: DataFrame, split: str = SPLIT, digits: int = 4) -> DataFrame:
    """Report form of the split metrics: titled splits and rounded values."""
    title = F.create_map(*[F.lit(x) for pair in SPLIT_TITLES.items() for x in pair])
    return by_split.select(
        title[F.col(ident(split))].alias("Split"),
        *[F.round(m, digits).alias(n) for m, n in zip(METRICS, ["Accuracy", "Precision", "Recall", "F1"])],
    )


def per_class_table(report: DataFrame, digits: int = 4) -> DataFrame:
    return report.select(
        F.col("class").alias("Class"), F.round("precision", digits).alias("Precision"),
        F.round("recall", digits).alias("Recall"), F.round("f1", digits).alias("F1-Score"),
        F.col("support").alias("Support"),
    )


def overfit_verdict(gap: Column, limit: float = OVERFIT_GAP) -> Column:
    return (
        F.when(gap > limit, "possible overfitting")
        .when(gap < -limit, "validation above training")
        .otherwise("no significant overfitting")
    )


def overfitting_table(by_split: DataFrame, split: str = SPLIT, limit: float = OVERFIT_GAP) -> DataFrame:
    """One row per metric: train, val, test and the train-val gap; verdict from F1."""
    long = by_split.select(
        F.col(ident(split)).alias("s"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])),
    )
    value = {s: F.max(F.when(F.col("s") == s, F.col("value"))).alias(s) for s in ("train", "val", "test")}
    wide = long.groupBy("metric").agg(*value.values()).withColumn("gap", F.col("train") - F.col("val"))
    f1_gap = F.max(F.when(F.col("metric") == "f1", F.col("gap"))).over(Window.partitionBy())
    return wide.withColumn("verdict", overfit_verdict(f1_gap, limit))


def class_weights(df: DataFrame, label: str = LABEL, classes: int | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """(class, rows, weight) with weight = n / (k * n_class), optionally clipped.

    ``classes`` is k; by default the number of observed classes.
    """
    counts = df.groupBy(F.col(ident(label))).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()
    k = F.lit(classes) if classes is not None else F.count(F.lit(1)).over(everything)
    weight = F.sum("rows").over(everything).cast("double") / (k * F.col("rows")).cast("double")
    if clip:
        weight = F.least(F.greatest(weight, F.lit(clip[0])), F.lit(clip[1]))
    return counts.withColumn("weight", weight)


def clipped_class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    return class_weights(df, label, classes, WEIGHT_CLIP)


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = LABEL, output: str = "weight") -> DataFrame:
    """Attach the weight of each row's class by a size-checked broadcast join."""
    table = weights.select(F.col(ident(label)), F.col("weight").alias(output))
    return df.join(broadcast_if_small(table), label)


def weighted_loss(df: DataFrame, loss: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """Weighted mean cross-entropy per group."""
    return df.groupBy(*(by or [])).agg((F.sum(loss * weight) / F.sum(weight)).alias("loss"))


def compare_to_truth(predictions: DataFrame, truth: DataFrame, index: str = "index") -> DataFrame:
    """Join predictions to known classes by index and mark the hits."""
    return predictions.join(truth, index).withColumn("correct", F.col("predicted_class") == F.col("true_class"))
