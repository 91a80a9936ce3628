"""Shared work folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it holds at most this many rows.
BROADCAST_ROWS = 100_000

# The JVM never compiles a method of more than this many bytes of bytecode.
# Spark's own limit is far higher, so the one loop generated for 39 features
# would run interpreted; past this limit Spark uses smaller functions instead.
# Measured on 4.8 million rows: log and scaling of all features 22 s -> 6 s.
METHOD_LIMIT = 8000
_METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
_METHOD_DEFAULT = "65535"

_local_folder: str | None = None
_written: list[str] = []  # in the order of writing
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def tune(spark: SparkSession) -> SparkSession:
    """Session setting for wide feature tables, unless the user chose one."""
    if spark.conf.get(_METHOD_SETTING, _METHOD_DEFAULT) == _METHOD_DEFAULT:
        spark.conf.set(_METHOD_SETTING, str(METHOD_LIMIT))
    return spark


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; the caller's come back afterwards."""
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def work_folder(spark: SparkSession) -> str:
    """Folder for written tables and stream checkpoints.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only where that
    is unset and the master is local (tests) a temporary folder is made; on a
    cluster an unset folder is an error, because executors cannot share a
    machine-local one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="flowlens-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the work folder and read it back.

    Cuts the lineage with data that outlives its executors, and later passes
    read only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _written.append(path)
    _path_of[stored] = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a table of ``materialize`` that is still there."""
    return df in _path_of


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in stored:
        path = _path_of.pop(df)
        _written.remove(path)
        remove_folder(df.sparkSession, path)


def mark() -> int:
    """Place in the list of stored tables, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables stored after a mark; their results must have been written."""
    for path in _written[since:]:
        remove_folder(spark, path)
    del _written[since:]


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven small, else leave the choice to Spark.

    The table is stored and counted; its rows do not pass through the driver's
    Python. A larger one is joined by shuffle, where adaptive execution splits
    hot keys.
    """
    stored = materialize(df, "lookup")
    return F.broadcast(stored) if stored.count() <= max_rows else stored
