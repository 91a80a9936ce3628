"""Queries over cleaning, sanitizing and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import decode, derive_labels, encode, is_attack
from ..functions.numeric import percent, round_probability, round_sample, text_or_null, to_number
from ..operators import cleaning
from ..operators.medians import column_medians, column_summary
from ..operators.sanitize import (
    COARSE_LABELS, adjustment_summary, clean_names, drop_labels, fill_means, missing_features, normalize_header, sanitize,
)
from ..operators.transforms import apply_log, apply_scaler, fit_log_shifts, fit_scaler, log_minimums, scaler_values
from ..plans.flows import ROW_ID, flows
from ..schema import CLASSES_FINE, FEATURES_COARSE, FEATURES_FINE, LABEL, LOG_FEATURES, ident
from ..workspace import materialize
from .common import (
    clean_cte, feature_profile, fine_preprocessing, finite_sql, labelled, log_sql, profile_sql, scaler_cte,
)
from .registry import query
from .sqltext import over_flows, quoted, stacked, text

# --- projections and filters --------------------------------------------------

_ODD_LABEL = "CASE WHEN l_orderkey % 37 = 0 THEN 'N/A' WHEN l_orderkey % 41 = 0 THEN '' ELSE \"Label\" END"


@query("p01_labelled_rows", over_flows(f"""
SELECT label AS "Label", count(*) AS rows FROM (SELECT {_ODD_LABEL} AS label FROM flows)
WHERE label NOT IN ('N/A', '') GROUP BY label"""))
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_orderkey") % 37 == 0, "N/A").when(F.col("l_orderkey") % 41 == 0, "").otherwise(F.col(LABEL))
    df = flows(spark, sf_dir).select(text_or_null(odd).alias(LABEL))
    return cleaning.drop_unlabelled(df).groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("p02_numeric_columns", over_flows(stacked([*_KEYS, "confidence", *FEATURES_FINE], "flows", {"filled": "count({c})"})))
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    names = cleaning.numeric_columns(df)
    return feature_profile(df.select(*[F.col(ident(c)).cast("double") for c in names]), names).select("feature", "filled")


@query("p03_infinite_to_null", over_flows(profile_sql(FEATURES_FINE, "clean"), clean_cte()))
def infinite_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_profile(cleaning.null_infinite(flows(spark, sf_dir), FEATURES_FINE), FEATURES_FINE)


@query("p04_median_values", over_flows(stacked(FEATURES_FINE, "clean", {"median": "round(median({c}), 6)"}), clean_cte()))
def median_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = column_medians(flows(spark, sf_dir), FEATURES_FINE)
    df = spark.createDataFrame(list(medians.items()), "feature string, median double")
    return df.withColumn("median", F.round("median", 6))


_IMPUTED = ", ".join(f"coalesce({quoted(f)}, (SELECT median({quoted(f)}) FROM clean), 0.0) AS {quoted(f)}" for f in FEATURES_FINE)


@query("p04_median_impute", over_flows(
    stacked(FEATURES_FINE, "filled", {"filled": "count({c})", "low": "round(min({c}), 6)", "high": "round(max({c}), 6)", "mean": "round(avg({c}), 3)"}),
    clean_cte(), f"filled AS (SELECT {_IMPUTED} FROM clean)"))
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(flows(spark, sf_dir).select(*[F.col(ident(f)) for f in FEATURES_FINE]), "input")
    data = cleaning.clean(stored, FEATURES_FINE, drop_constants=False).data
    facts = {"filled": F.count, "low": F.min, "high": F.max, "mean": F.avg}
    wide = data.agg(*[fact(F.col(ident(f)).cast("double")).alias(f"{name}{i}") for i, f in enumerate(FEATURES_FINE) for name, fact in facts.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"filled{i}").alias("filled"), F.round(f"low{i}", 6).alias("low"),
                 F.round(f"high{i}", 6).alias("high"), F.round(f"mean{i}", 3).alias("mean"))
        for i, f in enumerate(FEATURES_FINE)
    ])))


@query("p05_constant_columns", over_flows(
    "SELECT feature FROM (" + stacked(FEATURES_FINE, "clean", {"n": "count(DISTINCT {c})"}) + ") WHERE n <= 1", clean_cte()))
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cleaning.constant_columns(column_summary(flows(spark, sf_dir), FEATURES_FINE))
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("p06_complete_rows", over_flows(
    'SELECT "Label", count(*) AS rows FROM clean WHERE ' + " AND ".join(f"{quoted(f)} IS NOT NULL" for f in FEATURES_FINE) + ' GROUP BY "Label"',
    clean_cte()))
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.null_infinite(flows(spark, sf_dir), FEATURES_FINE)
    return cleaning.drop_incomplete_rows(df).groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))


_ALL_SQL = ", ".join(map(quoted, FEATURES_FINE))
#: Flows with planted repeats: every seventh order is one and the same row, and second items come twice.
_PLANTED_SQL = "planted AS (SELECT flow_id, " + ", ".join(
    f"CASE WHEN l_orderkey % 7 = 0 THEN CAST({i} AS DOUBLE) ELSE {quoted(f)} END AS {quoted(f)}" for i, f in enumerate(FEATURES_FINE)
) + " FROM (SELECT * FROM flows UNION ALL SELECT * REPLACE ('copy-' || flow_id AS flow_id) FROM flows WHERE l_linenumber = 2))"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    copies = df.where("l_linenumber = 2").withColumn(ROW_ID, F.concat(F.lit("copy-"), ROW_ID))
    one = F.col("l_orderkey") % 7 == 0
    return df.unionByName(copies).select(ROW_ID, *[F.when(one, float(i)).otherwise(F.col(ident(f))).alias(f) for i, f in enumerate(FEATURES_FINE)])


@query("p07_distinct_rows", over_flows(f"SELECT {_ALL_SQL}, min(flow_id) AS flow_id FROM planted GROUP BY {_ALL_SQL}", _PLANTED_SQL))
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_duplicate_rows(_planted(spark, sf_dir), ROW_ID)


@query("p07_duplicate_summary", over_flows(f"""
SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n) - count(*) AS BIGINT) AS rows_removed,
  CAST(sum(n) - count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100 AS removed_pct
FROM (SELECT count(*) AS n FROM planted GROUP BY {_ALL_SQL})""", _PLANTED_SQL))
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.duplicate_summary(_planted(spark, sf_dir), ROW_ID)


@query("p08_float32", over_flows(stacked(
    FEATURES_FINE, "flows", {"filled": "count({c})", "low": "CAST(min(CAST({c} AS FLOAT)) AS DOUBLE)", "high": "CAST(max(CAST({c} AS FLOAT)) AS DOUBLE)"})))
def float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_profile(cleaning.to_float32(flows(spark, sf_dir), FEATURES_FINE), FEATURES_FINE)


@query("p09_reduced_features", over_flows(profile_sql(FEATURES_COARSE, "flows")))
def reduced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.drop_redundant_features(flows(spark, sf_dir).select(*[F.col(ident(f)) for f in FEATURES_FINE]))
    return feature_profile(df, df.columns)


# Scoring input with an untidy header and text cells. "rate" is not "Rate".
_BOM = "﻿"


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    tcp = F.when(F.col("l_orderkey") % 3 == 0, "abc").when(F.col("l_orderkey") % 3 == 1, "1,2").otherwise(F.col("TCP").cast("string"))
    udp = F.when(F.col("l_orderkey") % 5 == 0, "1.5f").when(F.col("l_orderkey") % 5 == 1, "N/A").otherwise(F.concat(F.lit(" "), F.col("UDP").cast("string")))
    return df.select(
        F.col("Header_Length").alias(f"{_BOM}Header_Length"), F.col("Rate").alias(" Rate "), F.col("Rate").alias("rate"),
        F.col("AVG"), F.col("`Tot sum`").alias("Tot sum "), tcp.alias("TCP"), udp.alias("UDP"),
        F.col(LABEL).alias("LABEL"), F.col(LABEL).alias("label_8"), F.col("confidence").alias("extra"), F.col(ROW_ID),
    )


_PRESENT = ["Header_Length", "Rate", "TCP", "UDP", "Tot sum", "AVG"]
_MISSING_COARSE = [f for f in FEATURES_COARSE if f not in _PRESENT]
_UNTIDY_SQL = {
    "Header_Length": quoted("Header_Length"), "Rate": finite_sql("Rate"), "AVG": quoted("AVG"), "Tot sum": quoted("Tot sum"),
    "TCP": 'CASE WHEN l_orderkey % 3 = 2 THEN "TCP" END',
    "UDP": 'CASE WHEN l_orderkey % 5 >= 2 THEN "UDP" END',
}
_SANITIZED = "tidy AS (SELECT flow_id, " + ", ".join(
    f"{_UNTIDY_SQL.get(f, 'CAST(NULL AS DOUBLE)')} AS {quoted(f)}" for f in FEATURES_COARSE
) + " FROM flows)"


@query("p10_normalized_header", over_flows(
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, {text(n)})" for i, n in enumerate(
        ["Header_Length", "Rate", "rate", "AVG", "Tot sum", "TCP", "UDP", "LABEL", "label_8", "extra", "flow_id"])) + ") v(position, name), (SELECT count(*) AS rows FROM flows)"))
def normalized_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = normalize_header(_untidy(spark, sf_dir))
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name")) for i, n in enumerate(tidy.columns)])
    return tidy.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(names))


@query("p11_without_labels", over_flows(
    "SELECT name, rows FROM (VALUES ('Header_Length'), ('Rate'), ('rate'), ('AVG'), ('Tot sum'), ('TCP'), ('UDP'), ('extra'), ('flow_id')) v(name), (SELECT count(*) AS rows FROM flows)"))
def without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = drop_labels(normalize_header(_untidy(spark, sf_dir)), COARSE_LABELS)
    return tidy.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*[F.lit(n) for n in tidy.columns])).alias("name"))


@query("p12_missing_features", over_flows(
    "SELECT feature, rows FROM (VALUES " + ", ".join(f"({text(f)})" for f in _MISSING_COARSE) + ") v(feature), (SELECT count(*) AS rows FROM flows)"))
def missing_feature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    untidy = _untidy(spark, sf_dir)
    missing = missing_features(clean_names(untidy.columns), FEATURES_COARSE)
    return untidy.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*[F.lit(f) for f in missing])).alias("feature"))


@query("p13_training_order", over_flows(
    "SELECT p.position, t.* FROM (" + profile_sql(FEATURES_COARSE, "tidy") + ") t JOIN (VALUES "
    + ", ".join(f"({i}, {text(f)})" for i, f in enumerate(FEATURES_COARSE)) + ") p(position, feature) ON t.feature = p.feature", _SANITIZED))
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = sanitize(_untidy(spark, sf_dir), FEATURES_COARSE, COARSE_LABELS)
    places = F.array(*[F.lit(c) for c in tidy.data.columns])
    return feature_profile(tidy.data, FEATURES_COARSE).withColumn("position", (F.array_position(places, F.col("feature")) - 1).cast("int"))


@query("p14_numbers_from_text", over_flows("""
SELECT token, count(*) AS rows, count(value) AS numbers, min(value) AS low, max(value) AS high FROM (
  SELECT l_linenumber % 7 AS token, CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN "Tot sum" WHEN 2 THEN NULL
    WHEN 3 THEN NULL WHEN 4 THEN CAST('Infinity' AS DOUBLE) WHEN 5 THEN -"Tot sum" ELSE NULL END AS value FROM flows) GROUP BY token"""))
def numbers_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("`Tot sum`").cast("string")
    token = F.col("l_linenumber") % 7
    odd = (
        F.when(token == 0, "").when(token == 1, number).when(token == 2, F.concat(number, F.lit("f"))).when(token == 3, "1,2")
        .when(token == 4, "inf").when(token == 5, F.concat(F.lit(" -"), number, F.lit(" "))).otherwise("None")
    )
    df = flows(spark, sf_dir).select(token.alias("token"), to_number(text_or_null(odd)).alias("value"))
    return df.groupBy("token").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("numbers"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query("p15_mean_filled", over_flows(
    stacked(FEATURES_COARSE, "filled", {"filled": "count({c})", "low": "round(min({c}), 4)", "high": "round(max({c}), 4)"}),
    _SANITIZED, clean_cte(), scaler_cte(FEATURES_COARSE, "clean"),
    "filled AS (SELECT " + ", ".join(f"coalesce({quoted(f)}, m{i}) AS {quoted(f)}" for i, f in enumerate(FEATURES_COARSE)) + " FROM tidy JOIN scaler ON true)"))
def mean_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = sanitize(_untidy(spark, sf_dir), FEATURES_COARSE, COARSE_LABELS)
    scaler = fine_preprocessing(spark, sf_dir).scaler
    filled = fill_means(tidy.data, {f: scaler[f][0] for f in FEATURES_COARSE})
    return feature_profile(filled, FEATURES_COARSE).withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


@query("p16_features_and_labels", over_flows(
    "SELECT CASE WHEN feature IN ('Label', 'split') THEN 'label' ELSE 'feature' END AS role, feature AS name, filled FROM ("
    + stacked([*FEATURES_FINE, "Label", "split"], "flows", {"filled": "count({c})"}) + ")"))
def features_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(*[F.col(ident(f)) for f in FEATURES_FINE], LABEL, "split")
    features, labels = cleaning.split_features_label(df, [LABEL, "split"])
    roles = F.array(*[F.lit(x) for x in labels])
    wide = df.agg(*[F.count(F.col(ident(c))).alias(f"n{i}") for i, c in enumerate(features + labels)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(features + labels)])
    return wide.select(F.inline(rows)).withColumn("role", F.when(F.array_contains(roles, F.col("name")), "label").otherwise("feature"))


@query("p17_attack_rows", over_flows("SELECT predicted, count(*) AS rows FROM flows WHERE predicted <> 'BENIGN' GROUP BY predicted"))
def attack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where(is_attack(F.col("predicted"))).groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"))


# --- scalar functions ---------------------------------------------------------


@query("f01_family_of_class", over_flows(
    'SELECT "Label", family AS "Label_8", CASE WHEN "Label" = \'BENIGN\' THEN \'Benign\' ELSE \'Attack\' END AS "Label_2", count(*) AS rows FROM flows GROUP BY ALL'))
def family_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive_labels(flows(spark, sf_dir))
    return df.groupBy(LABEL, "Label_8", "Label_2").agg(F.count(F.lit(1)).alias("rows"))


@query("f02_binary_label", over_flows(
    'SELECT CASE WHEN "Label" = \'BENIGN\' THEN \'Benign\' ELSE \'Attack\' END AS "Label_2", count(*) AS rows FROM flows GROUP BY 1'))
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("Label_2").agg(F.count(F.lit(1)).alias("rows"))


@query("f03_log_shifts", over_flows(stacked(LOG_FEATURES, "clean", {"min": "min({c})"}), clean_cte()))
def log_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_log_shifts(flows(spark, sf_dir), LOG_FEATURES)


@query("f03_skew_log", over_flows(
    stacked(LOG_FEATURES, "logged", {"filled": "count({c})", "low": "round(min({c}), 6)", "high": "round(max({c}), 6)", "mean": "round(avg({c}), 6)"}),
    clean_cte(), "logged AS (SELECT " + ", ".join(f"{log_sql(f, 'clean')} AS {quoted(f)}" for f in LOG_FEATURES) + " FROM clean)"))
def skew_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.null_infinite(flows(spark, sf_dir), FEATURES_FINE)
    logged = apply_log(df, log_minimums(fit_log_shifts(df, LOG_FEATURES)))
    return _rounded_profile(logged, LOG_FEATURES, 6)


def _rounded_profile(df: DataFrame, features: list[str], digits: int) -> DataFrame:
    wide = df.agg(*[
        x for i, f in enumerate(features) for c in [F.col(ident(f))] for x in (
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}"),
        )
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f"n{i}").alias("filled"), F.round(f"a{i}", digits).alias("low"),
            F.round(f"b{i}", digits).alias("high"), F.round(f"m{i}", digits).alias("mean"),
        ) for i, f in enumerate(features)
    ])))


@query("f04_standardized", over_flows(
    stacked(FEATURES_FINE, "scaled", {"filled": "count({c})", "low": "round(min({c}), 6)", "high": "round(max({c}), 6)"}),
    clean_cte(), scaler_cte(FEATURES_FINE, "clean"),
    "scaled AS (SELECT " + ", ".join(f"({quoted(f)} - m{i}) / s{i} AS {quoted(f)}" for i, f in enumerate(FEATURES_FINE)) + " FROM clean JOIN scaler ON true)"))
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.null_infinite(flows(spark, sf_dir), FEATURES_FINE)
    scaler = fit_scaler(df.where("split = 'train'"), FEATURES_FINE)
    return _rounded_profile(apply_scaler(df, scaler_values(scaler)), FEATURES_FINE, 6).drop("mean")


@query("f05_encoded_labels", over_flows('SELECT "Label", class_idx AS code, "Label" AS decoded, count(*) AS rows FROM flows GROUP BY ALL'))
def encoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).withColumn("code", encode(F.col(LABEL), CLASSES_FINE))
    return df.withColumn("decoded", decode(F.col("code"), CLASSES_FINE)).groupBy(LABEL, "code", "decoded").agg(F.count(F.lit(1)).alias("rows"))


@query("f06_rounded", over_flows("""
SELECT round(confidence / 3, 4) AS probability, round("Tot sum" / 7, 6) AS sample, count(*) AS rows FROM flows GROUP BY ALL"""))
def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(
        round_probability(F.col("confidence") / 3).alias("probability"), round_sample(F.col("`Tot sum`") / 7).alias("sample"),
    )
    return df.groupBy("probability", "sample").agg(F.count(F.lit(1)).alias("rows"))


@query("f07_share_of_total", over_flows("""
SELECT split, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS pct FROM flows GROUP BY split"""))
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = flows(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("split", percent(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


# --- adjustments --------------------------------------------------------------


@query("a06_adjustment_summary", over_flows(f"""
SELECT count(*) FILTER (invalid > 0) AS rows_adjusted, CAST(sum(invalid) AS BIGINT) AS invalid_values_replaced,
  {text(",".join(_MISSING_COARSE))} AS missing FROM (
  SELECT {" + ".join(f"CAST({quoted(f)} IS NULL AS INT)" for f in FEATURES_COARSE)} AS invalid FROM tidy)""", _SANITIZED))
def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = adjustment_summary(sanitize(_untidy(spark, sf_dir), FEATURES_COARSE, COARSE_LABELS))
    return summary.select("rows_adjusted", "invalid_values_replaced", F.array_join("missing_features_filled", ",").alias("missing"))
