"""Health of a stream of scored flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import is_attack
from ..functions.numeric import share
from ..operators.monitoring import health, health_status
from ..schema import ident


def start_batch_health(stream: DataFrame, label: str, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Status of every micro-batch.

    Each batch overwrites its own folder, so a replayed batch leaves no
    duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        row = health(batch, label).withColumn("batch_id", F.lit(batch_id).cast("long"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def windowed_health(
    stream: DataFrame, label: str, time: str = "ts", width: str = "1 hour", lateness: str | None = "10 minutes",
) -> DataFrame:
    """Status per tumbling event-time window.

    State per window is two counters and the set of attack classes seen, which
    is bounded by the class catalog. Rows later than ``lateness`` are ignored.
    ``label`` must hold predicted classes.
    """
    rows = stream.withWatermark(time, lateness) if lateness else stream
    attack = is_attack(F.col(ident(label)))
    grouped = rows.groupBy(F.window(time, width)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(attack).alias("attacks"),
        F.size(F.collect_set(F.when(attack, F.col(ident(label))))).cast("long").alias("attack_types"),
    )
    ratio = share(F.col("attacks"), F.col("rows"))
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "rows", "attacks", "attack_types", ratio.alias("attack_share"),
        health_status(ratio, F.col("attack_types")).alias("status"),
    )


def start_windowed_health(
    windows: DataFrame, output: str, checkpoint: str, mode: str = "append", available_now: bool = False,
) -> StreamingQuery:
    """Write windows: ``append`` emits each once when it closes; ``complete``
    rewrites the whole table of windows with every micro-batch."""
    if mode == "append":
        writer = windows.writeStream.outputMode("append").format("parquet").option("path", output)
    else:
        def write(table: DataFrame, batch_id: int) -> None:
            table.write.mode("overwrite").parquet(output)

        writer = windows.writeStream.outputMode("complete").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
