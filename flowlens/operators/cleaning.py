"""Cleaning of raw flow tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, is_infinite, is_missing, percent
from ..schema import LABEL, REDUNDANT_FEATURES, ident
from .medians import column_medians, column_summary


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_unlabelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(F.col(ident(label)).isNotNull())


def replace_columns(df: DataFrame, values: dict) -> DataFrame:
    """Replace columns in place, keeping names and order."""
    return df.withColumns(values) if values else df


def null_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn +inf, -inf and NaN into null."""
    columns = numeric_columns(df) if columns is None else columns
    return replace_columns(df, {c: finite(F.col(ident(c))) for c in columns})


def cell_profile(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Null and infinity counts of every column, one row per column (and group).

    One aggregate over the data; the wide result is turned into rows after it.
    """
    columns = numeric_columns(df) if columns is None else columns
    by = by or []
    counts = []
    for i, c in enumerate(columns):
        col = F.col(ident(c))
        counts.append(F.count_if(is_missing(col)).alias(f"nulls{i}"))
        counts.append(F.count_if(is_infinite(col)).alias(f"infs{i}"))
    wide = df.groupBy(*by).agg(*counts)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"nulls{i}").alias("nulls"), F.col(f"infs{i}").alias("infs"))
        for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.inline(rows))


def infinite_columns(profile: DataFrame) -> DataFrame:
    return profile.where("infs > 0").select("feature")


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill nulls with per-column values; a column without a value gets 0."""
    return replace_columns(df, {
        c: F.coalesce(F.col(ident(c)), F.lit(0.0 if v is None else float(v))) for c, v in values.items()
    })


def constant_columns(summary: dict[str, dict]) -> list[str]:
    """Columns with at most one distinct value once nulls are imputed.

    Imputation fills with the median, which equals the only value of a column
    whose minimum and maximum agree, so the check needs no pass of its own.
    """
    return [c for c, s in summary.items() if s["values"] == 0 or s["min"] == s["max"]]


@dataclass
class Cleaned:
    data: DataFrame
    medians: dict[str, float | None]
    constants: list[str]


def clean(
    df: DataFrame,
    columns: list[str] | None = None,
    drop_constants: bool = True,
    fit_on: DataFrame | None = None,
) -> Cleaned:
    """Null infinities, impute medians and optionally drop constant columns.

    Statistics come from ``fit_on`` (default: all rows). Medians are computed
    only for columns that have something to fill.
    """
    columns = numeric_columns(df) if columns is None else columns
    source = df if fit_on is None else fit_on
    summary = column_summary(source, columns)
    if fit_on is None:
        incomplete = [c for c in columns if summary[c]["values"] < summary[c]["rows"]]
    else:
        incomplete = list(columns)
    medians = column_medians(source, incomplete, summary)
    constants = constant_columns(summary) if drop_constants else []
    filled = impute(null_infinite(df, incomplete), medians)
    return Cleaned(filled.drop(*constants), medians, constants)


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_duplicate_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Keep one row of each set of equal rows: the one with the lowest row id.

    Rows are grouped by a 128-bit digest of their values and combined before
    the shuffle, so a row that fills a third of the table reaches it once per
    task. Rows of one digest must agree in every column; if they did not, the
    job would fail rather than drop one.
    """
    if row_id is None:
        return df.dropDuplicates()
    data = [c for c in df.columns if c != row_id]
    kept = df.groupBy(*row_digest(df, data)).agg(F.min(F.col(ident(row_id))).alias("__id"), *_first_and_last(data))
    checked = kept.where(_agreed(data))
    values = {c: F.col(f"__low{i}") for i, c in enumerate(data)} | {row_id: F.col("__id")}
    return checked.select(*[values[c].alias(c) for c in df.columns])


def row_digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row's values. Which cells are null takes part; both zeros are one value, and so are all NaN."""
    numeric = set(numeric_columns(df))
    cells = [F.col(ident(c)) + F.lit(0) if c in numeric else F.col(ident(c)) for c in columns]
    nulls = F.concat(*[F.when(F.col(ident(c)).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(nulls, *cells).alias("__digest"), F.xxhash64(F.lit(1), nulls, *cells).alias("__digest2")]


def _first_and_last(columns: list[str]) -> list[Column]:
    return [f(F.col(ident(c))).alias(f"__{name}{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))]


def _agreed(columns: list[str]) -> Column:
    """True; an error where rows of one digest differ."""
    same = F.lit(True)
    for i in range(len(columns)):
        same = same & F.col(f"__low{i}").eqNullSafe(F.col(f"__high{i}"))
    return F.when(same, True).otherwise(F.raise_error(F.lit("two different rows share a 128-bit digest")).cast("boolean"))


_SEALS = [f"__seal{i}" for i in range(4)]


def _row_seals(df: DataFrame, columns: list[str]) -> list[Column]:
    """240 bits of the SHA-256 of a row's values as four numbers, which aggregate in place.

    Equal for the rows that ``row_digest`` means to be equal. Numbers end with a comma, other cells begin with their length.
    """
    numeric = set(numeric_columns(df))
    cells = []
    for c in columns:
        text = (F.col(ident(c)) + F.lit(0) if c in numeric else F.col(ident(c))).cast("string")
        cells.append(F.coalesce(F.concat(text, F.lit(",")) if c in numeric else F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-,")))
    seal = F.sha2(F.concat(*cells), 256)
    return [F.conv(F.substring(seal, 1 + 15 * i, 15), 16, 10).cast("long").alias(name) for i, name in enumerate(_SEALS)]


def duplicate_summary(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rows before, rows removed as duplicates, and their percentage.

    Only digests reach the shuffle, not the values: rows of one 128-bit digest
    must have one SHA-256 (240 bits of it), else the job fails.
    """
    data = [c for c in df.columns if c != row_id]
    sealed = df.select(*row_digest(df, data), *_row_seals(df, data))
    groups = sealed.groupBy("__digest", "__digest2").agg(F.count(F.lit(1)).alias("__copies"), *_first_and_last(_SEALS)).where(_agreed(_SEALS))
    totals = groups.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_kept"),
    )
    removed = F.col("rows_before") - F.col("rows_kept")
    return totals.select(
        "rows_before", removed.alias("rows_removed"), percent(removed, F.col("rows_before")).alias("removed_pct"),
    )


def to_float32(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    return replace_columns(df, {c: F.col(ident(c)).cast("float") for c in columns})


def drop_redundant_features(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in REDUNDANT_FEATURES if c in df.columns])


def split_features_label(df: DataFrame, labels: list[str]) -> tuple[list[str], list[str]]:
    """Feature names and the label names that are present, in table order."""
    return [c for c in df.columns if c not in labels], [c for c in df.columns if c in labels]
