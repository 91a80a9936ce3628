"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 200_000


def training_remainder(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3)).cast("int")


def labelled_sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_column: str = "doc_id") -> DataFrame:
    """(id, label, fold): at most ``rows`` training labels, the same on every run.

    One row per id (the larger label where a table repeats it), without null
    ids or labels and without held-out ids; larger tables give the ids of least
    hash.  The bound makes the result safe to broadcast.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    known = known.withColumn("fold", training_remainder("id")).where("fold <> 1")
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)
