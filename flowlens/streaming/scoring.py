"""Streaming scoring of JSON or CSV flow files.

The plan is the stateless batch scoring plan on a stream, so it needs no
watermark and keeps no state; the checkpoint only tracks which files are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sanitize import FINE_LABELS, sanitize
from ..schema import text_schema
from ..sources.csv_files import fields_in
from ..sources.records import LINE, REASON, record_features

Scorer = Callable[[DataFrame, list[str]], DataFrame]


def record_stream(spark: SparkSession, path: str, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """JSON lines, one record each, with an adjustment note per record.

    ``keep`` names record keys that are carried along as text.
    """
    return record_features(spark.readStream.text(path), features, keep=keep)


def csv_stream(spark: SparkSession, path: str, header: list[str], features: list[str], keep: list[str] | None = None) -> DataFrame:
    """CSV files with a known header, sanitized like a batch file.

    A file with another header, in names or order, stops the stream with an
    error before any of its rows is bound to a wrong column. A row longer than
    the header is marked as rejected; a shorter one has nulls.
    """
    reader = spark.readStream.schema(text_schema([*header, LINE])).option("header", True).option("enforceSchema", False)
    # without pruning every row is compared with the header's width
    rows = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", LINE).csv(path)
    clean = sanitize(rows, features, FINE_LABELS, [*(keep or []), LINE]).data
    long = F.coalesce(fields_in(F.col(LINE)) > len(header), F.lit(False))
    return clean.withColumns({REASON: F.when(long, "longer than the header"), "rejected": long, LINE: F.when(long, F.col(LINE))})


def start_scoring(stream: DataFrame, scorer: Scorer, keep: list[str], output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append predictions to Parquet files, exactly once per input file; rejected rows are not scored."""
    rows = stream.where(~F.col("rejected")) if "rejected" in stream.columns else stream
    return _append(scorer(rows, keep), output, checkpoint, available_now)


def start_rejects(stream: DataFrame, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the rejected rows, with their line, the reason and what was read of them, to an output of their own."""
    return _append(stream.where("rejected").drop("rejected"), output, checkpoint, available_now)


def _append(rows: DataFrame, output: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", output).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
