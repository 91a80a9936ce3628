"""Fitted column transforms: skew logarithm and standard scaling.

Fitted state is a small table with one row per feature, saved as Parquet and
inlined into expressions as literals when applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..schema import LOG_FEATURES, ident
from .cleaning import replace_columns


def fit_log_shifts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, min) of the listed skewed columns that the table has; one pass."""
    columns = [c for c in (LOG_FEATURES if columns is None else columns) if c in df.columns]
    wide = df.agg(*[F.min(finite(F.col(ident(c)))).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").cast("double").alias("min"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


def log_minimums(shifts: DataFrame) -> dict[str, float]:
    return {r["feature"]: r["min"] for r in shifts.collect()}


def skew_log(c: Column, minimum: float | None) -> Column:
    """log1p; a column with negative values is first moved so that it starts at 1.

    A value below the range that was fitted counts as its lower end: the fitted
    minimum, or 0 where that is not negative.
    """
    low = min(minimum or 0.0, 0.0)
    held = F.when(c < F.lit(low), F.lit(low)).otherwise(c)
    if low < 0:
        return F.log1p(held - F.lit(low) + F.lit(1.0))
    return F.log1p(held)


def apply_log(df: DataFrame, minimums: dict[str, float]) -> DataFrame:
    return replace_columns(df, {
        c: skew_log(F.col(ident(c)), m) for c, m in minimums.items() if c in df.columns
    })


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale): population deviation, 1 where it is zero; one pass."""
    wide = df.agg(
        *[F.avg(F.col(ident(c))).alias(f"mean{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(ident(c))).alias(f"std{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"mean{i}").alias("mean"),
            F.when(F.col(f"std{i}") == 0, 1.0).otherwise(F.col(f"std{i}")).alias("scale"),
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def standardized(c: Column, mean: float, scale: float) -> Column:
    return (c - F.lit(mean)) / F.lit(scale)


def apply_scaler(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {c: standardized(F.col(ident(c)), m, s) for c, (m, s) in values.items()})


def zero_variance_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Names of the features whose sample variance is zero; one pass."""
    wide = df.agg(*[F.var_samp(F.col(ident(c))).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows)).where("variance = 0").select("feature")
