"""Queries over sources and sinks: files are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.sanitize import FINE_LABELS, adjustment_summary, sanitize
from ..operators.scoring import score_fine_linear
from ..plans.flows import ROW_ID, flows
from ..schema import CLASSES_FINE, FEATURES_FINE, LABEL, SPLIT, ident
from ..sources import tables
from ..sources.tables import move_ordered_files
from ..sources.csv_files import load_coarse_flows, load_fine_flows, read_scoring_csv
from ..sources.records import read_records, record_features
from ..workspace import discard, materialize, new_path
from .aggregates import CM_CTE, REPORT_CTE
from .common import (
    clean_cte, csv_folder, feature_profile, fine_preprocessing, fixed_weights, json_folder, profile_sql,
)
from .registry import query, shared
from .sqltext import over_flows, text

_PER_CLASS = """SELECT "Label", count(*) AS rows, count("AVG") AS avg_filled, count(*) FILTER (isinf("Rate")) AS rate_infs,
  min("Tot sum") AS low, max("IAT") AS high FROM {} GROUP BY "Label" """


def _per_class(df: DataFrame) -> DataFrame:
    return df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("rows"), F.count("AVG").alias("avg_filled"),
        F.count_if(F.col("Rate") == float("inf")).alias("rate_infs"),
        F.min("`Tot sum`").alias("low"), F.max("IAT").alias("high"),
    )


@query("s01_csv_files", over_flows(_PER_CLASS.format("flows")))
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_class(load_fine_flows(spark, csv_folder(spark, sf_dir)))


@query("s02_csv_files_strict", over_flows(_PER_CLASS.format("(SELECT * FROM flows WHERE split <> 'test')")))
def csv_files_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_class(load_coarse_flows(spark, csv_folder(spark, sf_dir)))


@query("s03_scoring_csv", over_flows(profile_sql(FEATURES_FINE, "clean WHERE split = 'test'"), clean_cte()))
def scoring_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_scoring_csv(spark, csv_folder(spark, sf_dir) + "/Merged07.csv")
    return feature_profile(sanitize(rows, FEATURES_FINE, FINE_LABELS).data, FEATURES_FINE)


#: Rows of a file of ordered parts: more rows make more files, not larger ones.
_PART_ROWS = 250_000


def _ordered_parts(spark: SparkSession, sf_dir: str, part_rows: int = _PART_ROWS) -> str:
    """A folder of three CSV parts of unequal size, each in the order of its flow ids, in files of about ``part_rows`` rows."""

    def build() -> str:
        folder = new_path(spark, "parts") + ".csv"
        df = materialize(flows(spark, sf_dir).select(ROW_ID, "l_linenumber", "l_orderkey", *[F.col(ident(f)) for f in FEATURES_FINE]), "rows")
        for name, condition in (("a", "l_linenumber = 1"), ("b", "l_linenumber > 2"), ("c", "l_linenumber = 2 AND l_orderkey % 5 = 0")):
            part = df.where(condition).drop("l_linenumber", "l_orderkey")
            files = max(1, -(-part.count() // part_rows))
            move_ordered_files(part.repartitionByRange(files, ROW_ID).sortWithinPartitions(ROW_ID), f"{folder}/{name}")
        discard(df)
        return folder

    return shared(spark, sf_dir, f"ordered parts of {part_rows}", build)


@query("o10_file_index", over_flows("""
SELECT CAST(row_number() OVER (ORDER BY part, flow_id) - 1 AS BIGINT) AS "index", flow_id FROM (
  SELECT flow_id, CASE WHEN l_linenumber = 1 THEN 'a' WHEN l_linenumber > 2 THEN 'b' ELSE 'c' END AS part FROM flows
  WHERE l_linenumber <> 2 OR l_orderkey % 5 = 0)"""))
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_scoring_csv(spark, _ordered_parts(spark, sf_dir), "index").select("index", ROW_ID)


@query("s04_json_records", over_flows(profile_sql(FEATURES_FINE, "clean"), clean_cte()))
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_records(spark, json_folder(spark, sf_dir))
    return feature_profile(sanitize(rows, FEATURES_FINE, FINE_LABELS).data, FEATURES_FINE)


@query("s05_record_adjustments", over_flows("""
SELECT flow_id, CAST(1 AS BIGINT) AS rows_adjusted, CAST(CAST("AVG" IS NULL AS INT) + CAST(isinf("Rate") AS INT) AS BIGINT) AS invalid_values_replaced,
  CASE WHEN "AVG" IS NULL THEN 'AVG' ELSE '' END AS missing, false AS rejected
FROM flows WHERE "AVG" IS NULL OR isinf("Rate")"""))
def record_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_features(spark.read.text(json_folder(spark, sf_dir)), FEATURES_FINE, keep=[ROW_ID])
    note = F.col("input_adjustments")
    return rows.where(note.isNotNull()).select(
        ROW_ID, note["rows_adjusted"].alias("rows_adjusted"), note["invalid_values_replaced"].alias("invalid_values_replaced"),
        F.array_join(note["missing_features_filled"], ",").alias("missing"), "rejected",
    )


def _split_folder(spark: SparkSession, sf_dir: str) -> str:
    def build() -> str:
        path = new_path(spark, "splits")
        df = flows(spark, sf_dir).select(ROW_ID, LABEL, SPLIT, *[F.col(ident(f)) for f in FEATURES_FINE])
        tables.write_splits(df, path, FEATURES_FINE)
        return path

    return shared(spark, sf_dir, "split files", build)


@query("s06_split_scan", over_flows('SELECT "Label", count(*) AS rows FROM flows WHERE split = \'test\' GROUP BY "Label"'))
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_splits(spark, _split_folder(spark, sf_dir), "test").groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))


@query("s07_split_sink", over_flows("""
SELECT split, count(*) AS rows, min(CAST("Tot sum" AS FLOAT)) AS low, max(CAST("IAT" AS FLOAT)) AS high FROM flows GROUP BY split"""))
def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read_splits(spark, _split_folder(spark, sf_dir))
    return df.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("rows"), F.min("`Tot sum`").alias("low"), F.max("IAT").alias("high"))


_CATALOG_SQL = over_flows(f"""
SELECT CAST(39 AS BIGINT) AS num_features, CAST(34 AS BIGINT) AS num_classes, {text(",".join(FEATURES_FINE))} AS feature_names,
  {text(",".join(CLASSES_FINE))} AS class_names, count(*) FILTER (split = 'train') AS train_samples,
  count(*) FILTER (split = 'val') AS val_samples, count(*) FILTER (split = 'test') AS test_samples, 'order tables' AS source_data FROM flows""")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.catalog(flows(spark, sf_dir), FEATURES_FINE, {"class_names": CLASSES_FINE}, {"source_data": "order tables"})


def _flat_catalog(df: DataFrame) -> DataFrame:
    return df.select(
        "num_features", "num_classes", F.array_join("feature_names", ",").alias("feature_names"),
        F.array_join("class_names", ",").alias("class_names"), "train_samples", "val_samples", "test_samples", "source_data",
    )


@query("s08_catalog", _CATALOG_SQL)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_catalog(_catalog(spark, sf_dir))


@query("s09_catalog_file", _CATALOG_SQL)
def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> str:
        path = new_path(spark, "catalog")
        tables.write_catalog(_catalog(spark, sf_dir), path)
        return path

    return _flat_catalog(tables.read_catalog(spark, shared(spark, sf_dir, "catalog file", build)))


@query("s11_metrics_csv", over_flows("""
SELECT CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Validation' ELSE 'Test' END AS "Split",
  round(accuracy, 4) AS "Accuracy", round(precision, 4) AS "Precision", round(recall, 4) AS "Recall", round(f1, 4) AS "F1" FROM by_split""",
    CM_CTE, REPORT_CTE))
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "metrics")
    tables.write_report(metrics.metrics_table(metrics.metrics_by_split(flows(spark, sf_dir), LABEL, "predicted")), path)
    return spark.read.schema("Split string, Accuracy double, Precision double, Recall double, F1 double").option("header", True).csv(path)


_SAMPLE = "picked AS (SELECT *, row_number() OVER (ORDER BY flow_id) - 1 AS i FROM (SELECT * FROM flows WHERE split = 'test' ORDER BY md5('42:' || flow_id), flow_id LIMIT 20))"


@query("s12_demo_sample", over_flows(
    'SELECT CAST(i AS BIGINT) AS "index", "Label" AS true_class, round("Tot sum", 6) AS tot_sum, round("Variance", 6) AS variance, round("IAT", 6) AS iat FROM picked', _SAMPLE))
def demo_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, truth = tables.demo_sample(flows(spark, sf_dir).where("split = 'test'"), ROW_ID, FEATURES_FINE, LABEL)
    return records.join(truth, "index").select(
        "index", "true_class", F.col("`Tot sum`").alias("tot_sum"), F.col("Variance").alias("variance"), F.col("IAT").alias("iat"))


@query("s12_demo_sample_files", over_flows('SELECT CAST(i AS BIGINT) AS "index", "Label" AS true_class FROM picked', _SAMPLE))
def demo_sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sample")
    records, truth = tables.demo_sample(flows(spark, sf_dir).where("split = 'test'"), ROW_ID, FEATURES_FINE, LABEL)
    tables.write_sample(records, truth, path)
    return spark.read.schema("index long, true_class string").json(f"{path}/truth")


@query("s13_scored_sink", over_flows("""
SELECT 'flows.csv' AS filename, 'linear' AS model_used, count(*) AS total_rows, count(*) FILTER ("AVG" IS NULL OR "Rate" IS NULL) AS rows_adjusted,
  CAST(sum(CAST("AVG" IS NULL AS INT) + CAST("Rate" IS NULL AS INT)) AS BIGINT) AS invalid_values_replaced, '' AS missing, count(*) AS stored_rows FROM clean""",
    clean_cte()))
def scored_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored")
    tidy = sanitize(flows(spark, sf_dir), FEATURES_FINE, FINE_LABELS, [ROW_ID])
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    scored = score_fine_linear(tidy.data, fine_preprocessing(spark, sf_dir), weights, bias, CLASSES_FINE, [ROW_ID])
    tables.write_scored(scored, tables.run_summary(scored, adjustment_summary(tidy), "flows.csv", "linear"), path)
    stored = spark.read.parquet(f"{path}/predictions").agg(F.count(F.lit(1)).alias("stored_rows"), F.lit(1).alias("one"))
    schema = ("filename string, model_used string, total_rows long, "
              "input_adjustments struct<rows_adjusted: long, invalid_values_replaced: long, missing_features_filled: array<string>>")
    summary = spark.read.schema(schema).json(f"{path}/summary").withColumn("one", F.lit(1))
    return summary.join(stored, "one").select(
        "filename", "model_used", "total_rows", "input_adjustments.rows_adjusted", "input_adjustments.invalid_values_replaced",
        F.array_join("input_adjustments.missing_features_filled", ",").alias("missing"), "stored_rows",
    )


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("s14_preview", over_flows(f'SELECT flow_id, "Label", "Tot sum", "IAT" FROM flows ORDER BY {", ".join(_KEYS)} LIMIT 50'))
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(*_KEYS, ROW_ID, LABEL, "`Tot sum`", "IAT")
    return tables.preview(df, _KEYS).drop(*_KEYS)


@query("s14_preview_summary", over_flows("SELECT count(*) AS records, CAST(40 AS BIGINT) AS columns, least(count(*), 50) AS shown FROM flows"))
def preview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview_summary(flows(spark, sf_dir).select(LABEL, *[F.col(ident(f)) for f in FEATURES_FINE]))
