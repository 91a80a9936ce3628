"""Turning arbitrary scoring input into the model's feature columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, to_finite_number
from ..schema import BINARY_LABEL, FAMILY_LABEL, LABEL, ident

FINE_LABELS = [LABEL]
COARSE_LABELS = [LABEL, BINARY_LABEL, FAMILY_LABEL]


def clean_names(names: list[str]) -> list[str]:
    """Column names without byte-order marks and outer whitespace."""
    return [n.replace("﻿", "").strip() for n in names]


def normalize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def label_names(names: list[str], labels: list[str]) -> list[str]:
    """Names that spell one of the label columns, in any case."""
    wanted = {x.lower() for x in labels}
    return [n for n in names if n.lower() in wanted]


def drop_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.drop(*label_names(df.columns, labels))


def missing_features(names: list[str], features: list[str]) -> list[str]:
    """Expected features that are absent (names are case-sensitive).

    A table without any expected feature is refused.
    """
    present = set(names)
    if not present.intersection(features):
        raise ValueError("no expected feature column in the input")
    return [f for f in features if f not in present]


def _as_number(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return to_finite_number(c)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return finite(c.cast("double"))
    return F.lit(None).cast("double")


@dataclass
class Sanitized:
    """Features in training order as doubles, null where nothing valid was given."""

    data: DataFrame
    features: list[str]
    missing: list[str]


def sanitize(df: DataFrame, features: list[str], labels: list[str] = FINE_LABELS, keep: list[str] | None = None) -> Sanitized:
    """Normalize the header, pick the features by exact name and coerce them.

    Other columns are dropped unless listed in ``keep``. Columns are addressed
    by position, so names that differ only in case cannot be confused.
    """
    names = clean_names(df.columns)
    label_like = set(label_names(names, labels))
    usable = [n if n not in label_like else None for n in names]
    missing = missing_features([n for n in usable if n], features)
    repeated = sorted({n for n in usable if n in features and usable.count(n) > 1})
    if repeated:
        raise ValueError(f"repeated feature columns: {repeated}")
    types = [f.dataType for f in df.schema.fields]
    placed = df.toDF(*[f"__{i}" for i in range(len(names))])
    columns = [F.col(f"__{names.index(k)}").alias(k) for k in (keep or [])]
    for f in features:
        if f in missing:
            columns.append(F.lit(None).cast("double").alias(f))
        else:
            i = usable.index(f)
            columns.append(_as_number(F.col(f"__{i}"), types[i]).alias(f))
    return Sanitized(placed.select(*columns), features, missing)


def invalid_cells(features: list[str]) -> Column:
    """Number of cells of a row that need a replacement."""
    return sum((F.col(ident(f)).isNull().cast("int") for f in features), F.lit(0))


def adjustment_summary(clean: Sanitized) -> DataFrame:
    """Rows adjusted, cells replaced and missing features of the whole input.

    A missing column counts once in every row.
    """
    invalid = invalid_cells(clean.features).cast("long")
    missing = F.array(*[F.lit(m) for m in clean.missing]).cast("array<string>")
    return clean.data.agg(
        F.count_if(invalid > 0).alias("rows_adjusted"),
        F.coalesce(F.sum(invalid), F.lit(0)).alias("invalid_values_replaced"),
    ).withColumn("missing_features_filled", missing)


def fill_means(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Replace nulls by the training mean of the feature."""
    return df.withColumns({f: F.coalesce(F.col(ident(f)), F.lit(float(m))) for f, m in means.items()})
