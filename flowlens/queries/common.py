"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import binary_label, with_family
from ..operators.cleaning import null_infinite
from ..operators.scoring import Preprocessing
from ..operators.transforms import fit_log_shifts, fit_scaler, log_minimums, scaler_values
from ..plans.flows import ROW_ID, flows
from ..schema import BINARY_LABEL, FAMILY_LABEL, FEATURES_COARSE, FEATURES_FINE, LABEL, LOG_FEATURES, ident
from ..workspace import discard, materialize, new_path
from .registry import shared
from .sqltext import quoted, stacked, text

#: Sampling limits as shares of the counted rows (one of so many), so that classes are cut, raised and kept at any size.
TARGET_SHARE, FLOOR_SHARE, CAP_SHARE = 3, 120, 30
#: Rows of the tuning subset: one of so many.
SUBSET_SHARE = 15


def balance_limits(df: DataFrame) -> tuple[int, int, int]:
    """Target, floor and cap for the counted rows of a table."""
    rows = df.count()
    return rows // TARGET_SHARE, rows // FLOOR_SHARE, rows // CAP_SHARE


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with family and binary labels of truth and prediction."""
    df = with_family(flows(spark, sf_dir)).withColumn(BINARY_LABEL, binary_label(F.col(LABEL)))
    return with_family(df, "predicted", "predicted_family").withColumn("predicted_binary", binary_label(F.col("predicted")))


def scored_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in the shape of a coarse scored batch."""
    df = with_family(flows(spark, sf_dir), "predicted", "attack_family")
    return df.select(
        ROW_ID, binary_label(F.col("predicted")).alias("binary_prediction"), "attack_family",
        F.col("confidence").alias("confidence_binary"), (F.lit(1.0) - F.col("confidence") / 2).alias("confidence_attack"),
    )


SCORED_COARSE_CTE = """scored AS (SELECT flow_id, CASE WHEN predicted = 'BENIGN' THEN 'Benign' ELSE 'Attack' END AS binary_prediction,
  predicted_family AS attack_family, confidence AS confidence_binary, 1.0 - confidence / 2 AS confidence_attack FROM flows)"""


def finite_sql(feature: str) -> str:
    c = quoted(feature)
    return f"CASE WHEN isfinite({c}) THEN {c} END"


def clean_cte(features: list[str] = FEATURES_FINE, name: str = "clean") -> str:
    """Flows with infinities as null."""
    columns = ", ".join(f"{finite_sql(f)} AS {quoted(f)}" for f in features)
    return f'{name} AS (SELECT flow_id, "Label", family, split, class_idx, {columns} FROM flows)'


def fine_preprocessing(spark: SparkSession, sf_dir: str) -> Preprocessing:
    """Scaler of the 39 features, fitted on the training rows."""

    def build() -> Preprocessing:
        train = null_infinite(flows(spark, sf_dir).where("split = 'train'"), FEATURES_FINE)
        return Preprocessing(FEATURES_FINE, scaler_values(fit_scaler(train, FEATURES_FINE)))

    return shared(spark, sf_dir, "fine preprocessing", build)


def coarse_preprocessing(spark: SparkSession, sf_dir: str) -> Preprocessing:
    """Log minimums of all rows, then scaler of the logged training rows."""

    def build() -> Preprocessing:
        from ..operators.transforms import apply_log

        clean = null_infinite(flows(spark, sf_dir), FEATURES_COARSE)
        logged = [f for f in LOG_FEATURES if f in FEATURES_COARSE]
        minimums = log_minimums(fit_log_shifts(clean.select(*[F.col(ident(f)) for f in logged])))
        train = apply_log(clean, minimums).where("split = 'train'")
        return Preprocessing(FEATURES_COARSE, scaler_values(fit_scaler(train, FEATURES_COARSE)), minimums)

    return shared(spark, sf_dir, "coarse preprocessing", build)


def log_sql(feature: str, source: str) -> str:
    """Skew logarithm of a cleaned column, with its minimum taken over ``source``."""
    c = quoted(feature)
    low = f"(SELECT min({c}) FROM {source})"
    return f"CASE WHEN {low} < 0 THEN ln(1 + ({c} - {low} + 1)) ELSE ln(1 + {c}) END"


def coarse_logged_cte() -> str:
    columns = ", ".join(
        f"{log_sql(f, 'clean') if f in LOG_FEATURES else quoted(f)} AS {quoted(f)}" for f in FEATURES_COARSE
    )
    return f'logged AS (SELECT flow_id, "Label", family, split, class_idx, {columns} FROM clean)'


def scaler_cte(features: list[str], source: str, name: str = "scaler") -> str:
    columns = ", ".join(
        f"avg({quoted(f)}) AS m{i}, CASE WHEN stddev_pop({quoted(f)}) = 0 THEN 1.0 ELSE stddev_pop({quoted(f)}) END AS s{i}"
        for i, f in enumerate(features)
    )
    return f"{name} AS (SELECT {columns} FROM {source} WHERE split = 'train')"


# --- fixed linear weights, so that scores can be restated in SQL -------------


def fixed_weights(features: int, classes: int) -> tuple[list[list[float]], list[float]]:
    """weight[k][j] = ((7j + 13k) mod 11 - 5) / 10 and bias[k] = (k mod 5) / 10."""
    weights = [[((j * 7 + k * 13) % 11 - 5) / 10 for j in range(features)] for k in range(classes)]
    return weights, [(k % 5) / 10 for k in range(classes)]


def probability_ctes(features: list[str], source: str, classes: int, prefix: str) -> list[str]:
    """CTEs that end in ``{prefix}p(flow_id, k, p)``: one row per flow and class."""
    weights, bias = fixed_weights(len(features), classes)
    z = ", ".join(f"coalesce(({quoted(f)} - m{i}) / s{i}, 0.0) AS z{i}" for i, f in enumerate(features))
    logits = ", ".join(
        "CAST(" + repr(b) + " AS DOUBLE)" + "".join(f" + CAST({w!r} AS DOUBLE) * z{j}" for j, w in enumerate(ws) if w)
        for ws, b in zip(weights, bias)
    )
    return [
        scaler_cte(features, source, f"{prefix}scaler"),
        f'{prefix}z AS (SELECT flow_id, "Label", family, split, class_idx, {z} FROM {source} JOIN {prefix}scaler ON true)',
        f'{prefix}l AS (SELECT flow_id, "Label", family, split, class_idx, unnest([{logits}]) AS logit, unnest(range({classes})) AS k FROM {prefix}z)',
        f'{prefix}e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY flow_id)) AS e FROM {prefix}l)',
        f'{prefix}p AS (SELECT flow_id, "Label", family, split, class_idx, k, e / sum(e) OVER (PARTITION BY flow_id) AS p FROM {prefix}e)',
    ]


# --- files derived from the tables ------------------------------------------

#: Text files are packed, an eighth of their size, and bounded in rows: a packed file is read by one task.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "500000"}


def csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Flows as CSV: training, validation (columns reversed) and test files."""

    def build() -> str:
        folder = new_path(spark, "csv")
        columns = [F.col(ident(f)) for f in [*FEATURES_FINE, LABEL]]
        df = materialize(flows(spark, sf_dir).select("split", *columns), "rows")  # joined once for the three files
        for name, split, order in (("Merged01", "train", columns), ("Merged02", "val", columns[::-1]), ("Merged07", "test", columns)):
            df.where(F.col("split") == split).select(*order).write.options(header=True, **PACKED).csv(f"{folder}/{name}.csv")
        discard(df)
        return folder

    return shared(spark, sf_dir, "csv files", build)


def json_folder(spark: SparkSession, sf_dir: str) -> str:
    """Flows as JSON lines; null features are absent keys."""

    def build() -> str:
        folder = new_path(spark, "json")
        columns = [F.col(ident(f)) for f in [*FEATURES_FINE, LABEL]]
        flows(spark, sf_dir).select(ROW_ID, *columns).write.options(**PACKED).json(folder)
        return folder

    return shared(spark, sf_dir, "json files", build)


# --- small result shapes ----------------------------------------------------

PROFILE = {
    "filled": "count({c})", "low": "min({c})", "high": "max({c})",
}


def feature_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, filled, low, high): order-independent facts about each column."""
    wide = df.agg(*[
        x for i, f in enumerate(features) for x in (
            F.count(F.col(ident(f))).alias(f"n{i}"), F.min(F.col(ident(f))).cast("double").alias(f"a{i}"),
            F.max(F.col(ident(f))).cast("double").alias(f"b{i}"),
        )
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("filled"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"))
        for i, f in enumerate(features)
    ])))


def profile_sql(features: list[str], source: str) -> str:
    return stacked(features, source, PROFILE)


def values_sql(names: list[str], column: str) -> str:
    rows = ", ".join(f"({text(n)})" for n in names)
    return f"SELECT {column} FROM (VALUES {rows}) v({column})"
