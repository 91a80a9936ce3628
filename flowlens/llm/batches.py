"""Size of the Arrow batches that go to Python workers, and shuffle files that go with their job."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


#: Spark removes the shuffle files of a query once it has ended.
_PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def bounded_batches(spark: SparkSession):
    """Small batches for the jobs run inside; the caller's settings come back afterwards.

    A batch of the usual 10,000 texts is held several times over: as vectors and
    as a message outside the executor's heap, and by its Python worker.
    """
    return _settings(spark, _LIMITS)


def passing_shuffles(spark: SparkSession):
    """For the jobs run inside: shuffle files go with their job.

    Otherwise those of all jobs lie on disk until the driver happens to collect
    its garbage.
    """
    return _settings(spark, _PASSING)


def gathered(batches: Iterator[pa.RecordBatch], rows: int, text_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined in a row until they hold ``rows`` rows or ``text_bytes`` bytes, and larger ones cut by rows."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            held.append(whole.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= text_bytes:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)
