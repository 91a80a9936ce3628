"""Ranks within groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..workspace import materialize


def _places(group: str):
    """Adds the partition and the place among the partition's rows of the same group; rows come in group order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            change = np.ones(len(values), dtype=bool)
            change[1:] = values[1:] != values[:-1]
            first = np.flatnonzero(change)
            place = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
            if values[0] == last:
                head = first[1] if len(first) > 1 else len(values)
                place[:head] += seen
            last, seen = values[-1], int(place[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(values), part, dtype=np.int32)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__place"])

    return work


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in ``order`` within each value of the (non-null integer) column ``group``.

    Rows are dealt out by ranges of (group, order), so a large group covers
    many partitions; each counts its own rows and starts where the partitions
    before it end.  The numbered rows are written, as the counts must be of the
    very partitions that numbered them.
    """
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__place", LongType())])
    keys = [F.col(c) for c in [group, *order]]
    numbered = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_places(group), schema), "numbered")
    counts = numbered.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "starts")
    return numbered.join(starts, [group, "__part"]).withColumn(name, F.col("__start") + F.col("__place")).select(*df.columns, name)
