"""Queries over distributions, checks, metrics and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import observed_classes, unmapped_labels
from ..operators import checks, cleaning, distributions, metrics, monitoring
from ..operators.sampling import balance_plan, seeded_sample
from ..operators.transforms import apply_scaler, fit_scaler, zero_variance_features
from ..plans.flows import ROW_ID, flows
from ..schema import (
    BENIGN_CLASS, CLASSES_FINE, FAMILIES, FAMILY_LABEL, FEATURES_FINE, LABEL, SPLIT,
)
from ..sources.csv_files import load_fine_flows, rows_per_file
from .common import (
    CAP_SHARE, FLOOR_SHARE, SCORED_COARSE_CTE, TARGET_SHARE, balance_limits, clean_cte, csv_folder, fine_preprocessing, labelled,
    scaler_cte, scored_coarse,
)
from .registry import query
from .sqltext import over_flows, quoted, stacked, text


def _share(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)"


# --- distributions --------------------------------------------------------------


@query("a01_class_distribution", over_flows(f"""
SELECT "Label", count(*) AS rows, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
  {_share("count(*)", "sum(count(*)) OVER ()")} * 100 AS pct FROM flows GROUP BY "Label" """))
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.class_distribution(flows(spark, sf_dir))


@query("a02_family_distribution", over_flows(f"""
SELECT family AS "Label_8", count(*) AS rows, {_share("count(*)", "sum(count(*)) OVER ()")} * 100 AS pct
FROM flows GROUP BY family"""))
def family_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.family_distribution(labelled(spark, sf_dir))


@query("a03_rows_per_file", over_flows("""
SELECT CASE split WHEN 'train' THEN 'Merged01.csv' WHEN 'val' THEN 'Merged02.csv' WHEN 'test' THEN 'Merged07.csv' END AS source_file,
  count(*) AS rows FROM flows GROUP BY ROLLUP (split)"""))
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_per_file(load_fine_flows(spark, csv_folder(spark, sf_dir)))


@query("a04_observed_classes", over_flows('SELECT DISTINCT "Label" FROM flows'))
def classes_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_classes(flows(spark, sf_dir))


@query("a05_cell_profile", over_flows(stacked(
    FEATURES_FINE, "flows", {"nulls": "count(*) FILTER ({c} IS NULL)", "infs": "count(*) FILTER (isinf({c}))"})))
def cell_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cell_profile(flows(spark, sf_dir), FEATURES_FINE)


@query("a05_infinite_columns", over_flows(
    "SELECT feature FROM (" + stacked(FEATURES_FINE, "flows", {"infs": "count(*) FILTER (isinf({c}))"}) + ") WHERE infs > 0"))
def infinite_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.infinite_columns(cleaning.cell_profile(flows(spark, sf_dir), FEATURES_FINE))


PLAN_CTE = f"""counts AS (SELECT "Label", count(*) AS available FROM flows GROUP BY "Label"),
limits AS (SELECT CAST(sum(available) AS BIGINT) AS total FROM counts),
plan AS (SELECT "Label", available, least(available, greatest(total // {FLOOR_SHARE}, least(total // {CAP_SHARE},
  CAST(round_even(available * (CAST(total // {TARGET_SHARE} AS DOUBLE) / CAST(total AS DOUBLE)), 0) AS BIGINT)))) AS cap FROM counts, limits)"""


@query("a07_balance_plan", over_flows('SELECT "Label", available, cap, cap AS sampled FROM plan', PLAN_CTE))
def class_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    return balance_plan(df, LABEL, *balance_limits(df))


@query("a08_scaler", over_flows(
    " UNION ALL ".join(f"SELECT {text(f)} AS feature, round(m{i}, 4) AS mean, round(s{i}, 4) AS scale FROM scaler" for i, f in enumerate(FEATURES_FINE)),
    clean_cte(), scaler_cte(FEATURES_FINE, "clean")))
def scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = cleaning.null_infinite(flows(spark, sf_dir).where("split = 'train'"), FEATURES_FINE)
    return fit_scaler(train, FEATURES_FINE).select("feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


@query("a09_zero_variance", over_flows(
    "SELECT feature FROM (" + stacked(FEATURES_FINE, "clean WHERE split = 'train'", {"v": "var_samp({c})"}) + ") WHERE v = 0", clean_cte()))
def zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = cleaning.null_infinite(flows(spark, sf_dir).where("split = 'train'"), FEATURES_FINE)
    scaled = apply_scaler(train, fine_preprocessing(spark, sf_dir).scaler)
    return zero_variance_features(scaled, FEATURES_FINE)


@query("a10_clipped_class_weights", over_flows("""
SELECT family AS "Label_8", count(*) AS rows,
  least(greatest(CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(8 * count(*) AS DOUBLE), 0.1), 10.0) AS weight
FROM flows WHERE split = 'train' GROUP BY family"""))
def clipped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.clipped_class_weights(labelled(spark, sf_dir).where("split = 'train'"), FAMILY_LABEL, len(FAMILIES))


@query("a11_balanced_class_weights", over_flows("""
SELECT "Label", count(*) AS rows, CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight
FROM flows WHERE split = 'train' GROUP BY "Label" """))
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(flows(spark, sf_dir).where("split = 'train'"), LABEL)


# --- confusion and metrics --------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_counts(flows(spark, sf_dir), LABEL, "predicted", [SPLIT])


CM_CTE = 'cm AS (SELECT split, "Label" AS truth, predicted, count(*) AS n FROM flows GROUP BY ALL)'
REPORT_CTE = """sides AS (SELECT split, truth AS class, n AS support, 0 AS predicted_n, CASE WHEN truth = predicted THEN n ELSE 0 END AS hits FROM cm
  UNION ALL SELECT split, predicted, 0, n, 0 FROM cm),
sums AS (SELECT split, class, sum(support) AS support, sum(predicted_n) AS predicted_n, sum(hits) AS hits FROM sides GROUP BY ALL),
report AS (SELECT split, class,
  coalesce(CAST(hits AS DOUBLE) / nullif(CAST(predicted_n AS DOUBLE), 0), 0.0) AS precision,
  coalesce(CAST(hits AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0.0) AS recall,
  coalesce(CAST(2 * hits AS DOUBLE) / nullif(CAST(support + predicted_n AS DOUBLE), 0), 0.0) AS f1,
  CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits FROM sums),
by_split AS (SELECT split, CAST(sum(hits) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(precision) AS precision,
  avg(recall) AS recall, avg(f1) AS f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM report GROUP BY split)"""


@query("a12_confusion_counts", over_flows("SELECT * FROM cm", CM_CTE))
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query("a12_confusion_matrix", over_flows(
    "SELECT family AS truth, " + ", ".join(f"count(*) FILTER (predicted_family = {text(c)}) AS {quoted(c)}" for c in FAMILIES) + " FROM flows GROUP BY family"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(labelled(spark, sf_dir), FAMILY_LABEL, "predicted_family", FAMILIES)


@query("a13_confusion_shares", over_flows("""
SELECT split, truth, predicted, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY split, truth) AS DOUBLE) AS fraction,
  CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY split, truth) AS DOUBLE) * 100 AS pct FROM cm""", CM_CTE))
def confusion_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_shares(_counts(spark, sf_dir), [SPLIT])


@query("a14_accuracy", over_flows("SELECT split, avg(CASE WHEN \"Label\" = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM flows GROUP BY split"))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_by_split(flows(spark, sf_dir), LABEL, "predicted").select(SPLIT, "accuracy")


@query("a15_macro_metrics", over_flows(
    "SELECT split, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM by_split", CM_CTE, REPORT_CTE))
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.summary_metrics(_counts(spark, sf_dir), [SPLIT])
    return df.select(SPLIT, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a16_weighted_f1", over_flows("SELECT split, round(weighted_f1, 9) AS weighted_f1 FROM by_split", CM_CTE, REPORT_CTE))
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_metrics(_counts(spark, sf_dir), [SPLIT]).select(SPLIT, F.round("weighted_f1", 9).alias("weighted_f1"))


@query("a17_class_report", over_flows("SELECT class, precision, recall, f1, support, hits FROM report WHERE split = 'test'", CM_CTE, REPORT_CTE))
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _counts(spark, sf_dir).where("split = 'test'").drop(SPLIT)
    return metrics.class_report(test, classes=CLASSES_FINE)


@query("a18_metrics_by_split", over_flows("""
SELECT CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Validation' ELSE 'Test' END AS "Split",
  round(accuracy, 4) AS "Accuracy", round(precision, 4) AS "Precision", round(recall, 4) AS "Recall", round(f1, 4) AS "F1" FROM by_split""",
    CM_CTE, REPORT_CTE))
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_table(metrics.metrics_by_split(flows(spark, sf_dir), LABEL, "predicted"))


@query("a19_overfitting", over_flows("""
SELECT metric, round(train, 9) AS train, round(val, 9) AS val, round(test, 9) AS test, round(train - val, 9) AS gap,
  (SELECT CASE WHEN g > 0.05 THEN 'possible overfitting' WHEN g < -0.05 THEN 'validation above training' ELSE 'no significant overfitting' END
   FROM (SELECT max(CASE WHEN split = 'train' THEN f1 END) - max(CASE WHEN split = 'val' THEN f1 END) AS g FROM by_split)) AS verdict
FROM (SELECT metric, max(CASE WHEN split = 'train' THEN v END) AS train, max(CASE WHEN split = 'val' THEN v END) AS val,
  max(CASE WHEN split = 'test' THEN v END) AS test FROM (
  """ + " UNION ALL ".join(f"SELECT split, '{m}' AS metric, {m} AS v FROM by_split" for m in metrics.METRICS) + ") GROUP BY metric)", CM_CTE, REPORT_CTE))
def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.overfitting_table(metrics.metrics_by_split(flows(spark, sf_dir), LABEL, "predicted"))
    return table.select("metric", *[F.round(c, 9).alias(c) for c in ("train", "val", "test", "gap")], "verdict")


# --- checks -----------------------------------------------------------------------

SHARES_CTE = f"""shares AS (SELECT split, "Label", count(*) AS rows, {_share("count(*)", "sum(count(*)) OVER (PARTITION BY split)")} AS share
  FROM flows GROUP BY split, "Label")"""


@query("a20_split_shift", over_flows("""
SELECT max(abs(a.share - b.share)) AS max_difference, max(abs(a.share - b.share)) <= 0.02 AS passed
FROM shares a JOIN shares b ON a."Label" = b."Label" WHERE a.split = 'train' AND b.split = 'val'""", SHARES_CTE))
def split_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.split_shift(flows(spark, sf_dir))


def _without_rare(df: DataFrame) -> DataFrame:
    """Flows whose validation split lacks one class."""
    return df.where(~((F.col(SPLIT) == "val") & (F.col(LABEL) == "XSS")))


@query("a21_class_presence", over_flows("""
SELECT split, count(DISTINCT "Label") AS present, CAST(34 AS BIGINT) AS expected, CASE WHEN split = 'val' THEN 'XSS' ELSE '' END AS missing_names
FROM flows WHERE NOT (split = 'val' AND "Label" = 'XSS') GROUP BY split"""))
def class_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.class_presence(_without_rare(flows(spark, sf_dir)), CLASSES_FINE)


@query("a22_size_ratio", over_flows("""
SELECT count(*) AS rows, CAST(count(*) AS DOUBLE) / 1000000.0 AS ratio,
  CASE WHEN CAST(count(*) AS DOUBLE) / 1000000.0 BETWEEN 0.85 AND 1.15 THEN 'PASS' ELSE 'WARN' END AS verdict FROM flows"""))
def size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.size_ratio(flows(spark, sf_dir))


_BAD_CELLS = " + ".join(f"count(*) FILTER ({quoted(f)} IS NULL)" for f in FEATURES_FINE)
_INF_CELLS = " + ".join(f"count(*) FILTER (isinf({quoted(f)}))" for f in FEATURES_FINE)


@query("a23_clean_splits", over_flows(f"""
SELECT split, {_BAD_CELLS} AS nulls, {_INF_CELLS} AS infs, ({_BAD_CELLS} + {_INF_CELLS}) = 0 AS passed FROM flows GROUP BY split"""))
def clean_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.clean_splits(flows(spark, sf_dir), FEATURES_FINE)


@query("a24_split_sizes", over_flows(f"""
SELECT split, count(*) AS rows, {_share("count(*)", "sum(count(*)) OVER ()")} * 100 AS pct FROM flows GROUP BY split"""))
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.split_sizes(flows(spark, sf_dir))


@query("a25_split_class_shares", over_flows("SELECT * FROM shares", SHARES_CTE))
def split_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.class_shares(flows(spark, sf_dir), LABEL, [SPLIT])


# --- monitoring -------------------------------------------------------------------


@query("a26_prediction_summary", over_flows("""
SELECT count(*) AS total, count(*) FILTER (binary_prediction <> 'Benign') AS attacks, count(*) FILTER (binary_prediction = 'Benign') AS benign,
  round(avg(confidence_binary), 7) AS mean_binary_confidence,
  round(avg(CASE WHEN binary_prediction <> 'Benign' THEN confidence_attack END), 7) AS mean_attack_confidence,
  CAST(count(*) FILTER (binary_prediction <> 'Benign') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 AS attack_pct FROM scored""", SCORED_COARSE_CTE))
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = monitoring.prediction_summary(scored_coarse(spark, sf_dir))
    return df.withColumn("mean_binary_confidence", F.round("mean_binary_confidence", 7)).withColumn(
        "mean_attack_confidence", F.round("mean_attack_confidence", 7))


@query("a27_binary_distribution", over_flows("""
SELECT CASE WHEN c.class = 'Attack' THEN 1 ELSE 2 END AS rank, c.class, c.rows, CAST(c.rows AS DOUBLE) / CAST(sum(c.rows) OVER () AS DOUBLE) * 100 AS pct,
  CAST(c.rows AS DOUBLE) / CAST(max(c.rows) OVER () AS DOUBLE) * 100 AS width
FROM (SELECT binary_prediction AS class, count(*) AS rows FROM scored GROUP BY 1) c""", SCORED_COARSE_CTE))
def binary_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.binary_distribution(scored_coarse(spark, sf_dir))


@query("a28_family_predictions", over_flows("""
SELECT class, rows, round(mean, 7) AS mean_confidence, CAST(row_number() OVER (ORDER BY rows DESC, first) AS INT) AS rank,
  CAST(rows AS DOUBLE) / CAST(sum(rows) OVER () AS DOUBLE) * 100 AS pct, CAST(rows AS DOUBLE) / CAST(max(rows) OVER () AS DOUBLE) * 100 AS width
FROM (SELECT attack_family AS class, count(*) AS rows, avg(confidence_attack) AS mean, min(flow_id) AS first FROM scored GROUP BY 1)""", SCORED_COARSE_CTE))
def family_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = monitoring.family_predictions(scored_coarse(spark, sf_dir), ROW_ID)
    return df.withColumn("mean_confidence", F.round("mean_confidence", 7))


@query("a29_predicted_classes", over_flows(f"""
SELECT predicted AS predicted_class, count(*) AS rows, {_share("count(*)", "sum(count(*)) OVER ()")} * 100 AS pct FROM flows GROUP BY 1"""))
def predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.class_predictions(flows(spark, sf_dir).withColumnRenamed("predicted", "predicted_class"))


@query("a32_sample_classes", over_flows("""
SELECT "Label", count(*) AS rows FROM (SELECT * FROM flows WHERE split = 'test' ORDER BY md5('42:' || flow_id), flow_id LIMIT 20) GROUP BY "Label" """))
def sample_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = seeded_sample(flows(spark, sf_dir).where("split = 'test'"), ROW_ID, 20)
    return distributions.class_counts(sample)


_HEALTH = """CASE WHEN attack_share > 0.8 THEN 'Critical' WHEN attack_share > 0.3 AND attack_types >= 5 THEN 'Critical'
  WHEN attack_share <= 0.3 THEN 'Stable' ELSE 'Warning' END AS status"""


@query("a34_health", over_flows(f"""
SELECT *, {_HEALTH} FROM (SELECT split, count(*) AS rows, count(*) FILTER (predicted <> 'BENIGN') AS attacks,
  count(DISTINCT CASE WHEN predicted <> 'BENIGN' THEN predicted END) AS attack_types,
  CAST(count(*) FILTER (predicted <> 'BENIGN') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS attack_share FROM flows GROUP BY split)"""))
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.health(flows(spark, sf_dir), "predicted", [SPLIT])


_MIXES = f"""mixes AS (SELECT 'mild' AS mix, predicted FROM flows WHERE predicted IN ('BENIGN', 'RECON-PORTSCAN')
  UNION ALL SELECT 'two' , predicted FROM flows WHERE predicted IN ('BENIGN', 'DDOS-HTTP_FLOOD', 'DDOS-ICMP_FLOOD')
  UNION ALL SELECT 'many', predicted FROM flows)"""


@query("a34_health_of_mixes", over_flows(f"""
SELECT *, {_HEALTH} FROM (SELECT mix, count(*) AS rows, count(*) FILTER (predicted <> 'BENIGN') AS attacks,
  count(DISTINCT CASE WHEN predicted <> 'BENIGN' THEN predicted END) AS attack_types,
  CAST(count(*) FILTER (predicted <> 'BENIGN') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS attack_share FROM mixes GROUP BY mix)""", _MIXES))
def health_of_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select("predicted")
    p = F.col("predicted")
    mixes = F.array_compact(F.array(
        F.lit("many"), F.when(p.isin(BENIGN_CLASS, "RECON-PORTSCAN"), "mild"),
        F.when(p.isin(BENIGN_CLASS, "DDOS-HTTP_FLOOD", "DDOS-ICMP_FLOOD"), "two"),
    ))
    return monitoring.health(df.select("predicted", F.explode(mixes).alias("mix")), "predicted", ["mix"])


@query("a35_class_drift", over_flows("""
SELECT coalesce(a."Label", b."Label") AS class, coalesce(a.share, 0.0) AS batch_share, coalesce(b.share, 0.0) AS training_share,
  abs(coalesce(a.share, 0.0) - coalesce(b.share, 0.0)) AS difference,
  a.share IS NULL OR b.share IS NULL OR abs(a.share - b.share) > 0.001 AS alert
FROM (SELECT * FROM shares WHERE split = 'test') a
FULL JOIN (SELECT * FROM shares WHERE split = 'train') b ON a."Label" = b."Label"
""", SHARES_CTE))
def class_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    training = distributions.class_shares(df.where("split = 'train'"))
    return monitoring.class_drift(df.where("split = 'test'"), training, LABEL, tolerance=0.001)


_ATTACK_BATCH = "\"Label\" <> 'BENIGN' AND split = 'test'"


@query("a35_feature_drift", over_flows(
    "SELECT feature, round(shift, 5) AS shift, shift > 0.05 AS alert FROM ("
    + " UNION ALL ".join(
        f"SELECT {text(f)} AS feature, abs((SELECT avg({quoted(f)}) FROM clean WHERE {_ATTACK_BATCH}) - m{i}) / s{i} AS shift FROM scaler"
        for i, f in enumerate(FEATURES_FINE)) + ")", clean_cte(), scaler_cte(FEATURES_FINE, "clean")))
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = flows(spark, sf_dir).where((F.col(LABEL) != BENIGN_CLASS) & (F.col(SPLIT) == "test"))
    df = monitoring.feature_drift(batch, fine_preprocessing(spark, sf_dir).scaler, limit=0.05)
    return df.withColumn("shift", F.round("shift", 5))


@query("o09_ranked_classes", over_flows("""
SELECT class, rows, CAST(row_number() OVER (ORDER BY rows DESC, first) AS INT) AS rank FROM (
  SELECT predicted AS class, count(*) AS rows, min(flow_id) AS first FROM flows GROUP BY 1)"""))
def ranked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.ranked_classes(flows(spark, sf_dir), "predicted", "confidence", ROW_ID).select("class", "rows", "rank")


# --- relational forms ---------------------------------------------------------------


@query("j01_family_lookup", over_flows('SELECT flow_id, "Label", family AS "Label_8" FROM flows'))
def family_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(ROW_ID, LABEL, FAMILY_LABEL)


@query("j03_weight_lookup", over_flows("""
SELECT f.flow_id, f."Label", w.weight FROM flows f JOIN (
  SELECT "Label", CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight FROM flows GROUP BY "Label") w
ON f."Label" = w."Label" """))
def weight_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(ROW_ID, LABEL)
    return metrics.with_class_weight(df, metrics.class_weights(df)).select(ROW_ID, LABEL, "weight")


@query("j04_aligned_shares", over_flows("""
SELECT a."Label", a.share AS left_share, b.share AS right_share, abs(a.share - b.share) AS difference
FROM shares a JOIN shares b ON a."Label" = b."Label" WHERE a.split = 'train' AND b.split = 'test'""", SHARES_CTE))
def aligned_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = distributions.class_shares(flows(spark, sf_dir), LABEL, [SPLIT])
    return distributions.aligned_shares(shares.where("split = 'train'"), shares.where("split = 'test'"))


@query("j05_prediction_vs_truth", over_flows("""
SELECT flow_id AS "index", predicted AS predicted_class, "Label" AS true_class, predicted = "Label" AS correct FROM flows WHERE split = 'test'"""))
def prediction_vs_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    predictions = df.select(F.col(ROW_ID).alias("index"), F.col("predicted").alias("predicted_class"))
    truth = df.where("split = 'test'").select(F.col(ROW_ID).alias("index"), F.col(LABEL).alias("true_class"))
    return metrics.compare_to_truth(predictions, truth)


@query("j06_unmapped_labels", over_flows(
    "SELECT DISTINCT 'NEW-' || split AS \"Label\" FROM flows WHERE l_orderkey % 10 = 0"))
def labels_without_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("NEW-"), F.col(SPLIT))).otherwise(F.col(LABEL))
    return unmapped_labels(flows(spark, sf_dir).select(odd.alias(LABEL)))


@query("j06_missing_classes", over_flows("""
SELECT s.split, c.label AS "Label" FROM (VALUES ('train'), ('val'), ('test')) s(split), classes c
EXCEPT SELECT split, "Label" FROM flows WHERE NOT (split = 'val' AND "Label" = 'XSS')"""))
def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_classes(_without_rare(flows(spark, sf_dir)), CLASSES_FINE)


@query("j07_union_by_name", over_flows("""
SELECT CASE split WHEN 'train' THEN 'Merged01.csv' WHEN 'val' THEN 'Merged02.csv' ELSE 'Merged07.csv' END AS source_file, "Label",
  count(*) AS rows, max("Tot sum") AS high, min("IAT") AS low FROM flows GROUP BY 1, 2"""))
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_fine_flows(spark, csv_folder(spark, sf_dir))
    return df.groupBy("source_file", LABEL).agg(
        F.count(F.lit(1)).alias("rows"), F.max("`Tot sum`").alias("high"), F.min("IAT").alias("low"))


@query("j08_share_of_partition", over_flows('SELECT split, "Label", share FROM shares', SHARES_CTE))
def share_of_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.class_shares(flows(spark, sf_dir), LABEL, [SPLIT]).drop("rows")
