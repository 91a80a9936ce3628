"""Label derivation, encoding and the class catalog."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (
    ATTACK, BENIGN_CLASS, BENIGN_FAMILY, BINARY_LABEL, FAMILY_LABEL, FAMILY_OF_CLASS, LABEL, ident,
)


def family_table(spark: SparkSession) -> DataFrame:
    """Class to family lookup: one row per known class (34 rows)."""
    return spark.createDataFrame(list(FAMILY_OF_CLASS.items()), f"{LABEL} string, {FAMILY_LABEL} string")


def binary_label(label: Column) -> Column:
    return F.when(label == BENIGN_CLASS, BENIGN_FAMILY).otherwise(ATTACK)


def with_family(df: DataFrame, label: str = LABEL, family: str = FAMILY_LABEL) -> DataFrame:
    """Left-join the family of each row's class; unknown classes get null.

    The lookup has a fixed 34 rows, so broadcasting it is safe at any scale.
    """
    table = family_table(df.sparkSession).toDF(label, family)
    return df.join(F.broadcast(table), label, "left")


def unmapped_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Distinct labels that have no family."""
    known = family_table(df.sparkSession).select(F.col(LABEL).alias(label))
    return df.select(label).distinct().join(F.broadcast(known), label, "left_anti")


def derive_labels(df: DataFrame, label: str = LABEL, check: bool = True) -> DataFrame:
    """Add the family and the binary label; fail on labels without a family."""
    if check:
        unknown = unmapped_labels(df, label).where(F.col(label).isNotNull())
        shown = sorted(r[0] for r in unknown.limit(100).collect())
        if shown:
            raise ValueError(f"{unknown.count()} labels without a family, among them: {shown}")
    return with_family(df, label).withColumn(BINARY_LABEL, binary_label(F.col(label)))


def class_array(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def encode(label: Column, classes: list[str]) -> Column:
    """Zero-based position of a label in its sorted class list; unseen fails."""
    position = F.array_position(class_array(classes), label)
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(label, F.lit("null"))))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(unseen.cast("int"))


def decode(index: Column, classes: list[str]) -> Column:
    return F.element_at(class_array(classes), index.cast("int") + 1)


def label_indexer(classes: list[str], label: str, output: str) -> StringIndexerModel:
    """Spark ML encoder with a fixed, sorted class list."""
    return StringIndexerModel.from_labels(classes, inputCol=label, outputCol=output, handleInvalid="error")


def label_decoder(classes: list[str], index: str, output: str) -> IndexToString:
    return IndexToString(inputCol=index, outputCol=output, labels=classes)


def observed_classes(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Sorted distinct labels."""
    return df.select(F.col(ident(label)).alias(label)).where(F.col(label).isNotNull()).distinct().orderBy(label)


def is_attack(label: Column) -> Column:
    """A prediction counts as an attack unless it names the benign class."""
    return F.lower(label) != BENIGN_FAMILY.lower()
