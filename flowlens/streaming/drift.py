"""Drift of a stream of scored flows, batch by batch and over all batches so far.

A batch leaves its class counts and the count, sum and sum of squares of every
feature in a folder of its own. These add up, so the state of a stream is the
sum of its folders, and a batch that is replayed overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import is_attack
from ..functions.numeric import finite, share
from ..operators.monitoring import FEATURE_SHIFT_LIMIT, health_status
from ..schema import SHIFT_TOLERANCE, ident
from ..workspace import remove_folder

STATE = "kind string, name string, n long, total double, squares double"


def batch_state(batch: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(kind, name, n, total, squares): class counts and feature moments; one pass over the batch.

    Feature moments are kept per class, so one grouping gives both; the result
    has a row per class and per feature.
    """
    moments = []
    for i, f in enumerate(features):
        value = finite(F.col(ident(f)).cast("double"))
        moments += [F.count(value).alias(f"n{i}"), F.sum(value).alias(f"t{i}"), F.sum(value * value).alias(f"q{i}")]
    grouped = batch.groupBy(F.col(ident(label)).alias("name")).agg(F.count(F.lit(1)).alias("n"), *moments)
    nothing = F.lit(None).cast("double")
    rows = [F.struct(F.lit("class").alias("kind"), F.col("name"), F.col("n"), nothing.alias("total"), nothing.alias("squares"))]
    for i, f in enumerate(features):
        rows.append(F.struct(F.lit("feature").alias("kind"), F.lit(f).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total"), F.col(f"q{i}").alias("squares")))
    return merged(grouped.select(F.inline(F.array(*rows))))


def merged(state: DataFrame) -> DataFrame:
    """Sum of states."""
    return state.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def drift_of(state: DataFrame, training_shares: DataFrame, scaler: dict[str, tuple[float, float]], tolerance: float = SHIFT_TOLERANCE, limit: float = FEATURE_SHIFT_LIMIT) -> DataFrame:
    """One row: health, largest class shift and feature shift, and how many of each raise an alert.

    A class that only one side has counts as share 0 on the other, and alerts.
    ``training_shares`` has the columns class and share.
    """
    classes = state.where("kind = 'class'")
    attack = is_attack(F.col("name"))
    totals = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("attacks"),
        F.count_if(attack & (F.col("n") > 0)).alias("attack_types"),
    )
    # over one row per class
    counted = classes.select(F.col("name").alias("class"), "n", F.sum("n").over(Window.partitionBy()).alias("rows"))
    both = counted.join(training_shares.select("class", "share"), "class", "full")
    shift = F.abs(F.coalesce(share(F.col("n"), F.col("rows")), F.lit(0.0)) - F.coalesce(F.col("share"), F.lit(0.0)))
    one_sided = F.col("n").isNull() | F.col("share").isNull()
    by_class = both.agg(F.max(shift).alias("class_shift"), F.count_if(one_sided | (shift > tolerance)).alias("class_alerts"))
    places = F.create_map(*[x for f, (m, s) in scaler.items() for x in (F.lit(f), F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("scale")))])
    mean = F.try_divide(F.col("total"), F.col("n"))
    moved: Column = F.abs(mean - places[F.col("name")]["mean"]) / places[F.col("name")]["scale"]
    by_feature = state.where("kind = 'feature'").agg(F.max(moved).alias("feature_shift"), F.count_if(moved > limit).alias("feature_alerts"))
    ratio = share(F.col("attacks"), F.col("rows"))
    # three tables of one row, under one key
    one = totals.withColumn("attack_share", ratio).withColumn("status", health_status(F.col("attack_share"), F.col("attack_types")))
    parts = [t.withColumn("__one", F.lit(1)) for t in (one, by_class, by_feature)]
    return parts[0].join(parts[1], "__one").join(parts[2], "__one").drop("__one")


def start_drift(
    stream: DataFrame, label: str, features: list[str], training_shares: DataFrame, scaler: dict[str, tuple[float, float]], output: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Health and drift of every micro-batch, and of all batches up to it, under ``output``/drift; state under ``output``/state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{output}/state/batch={batch_id}"
        batch_state(batch, label, features).coalesce(1).write.mode("overwrite").parquet(path)
        mine = spark.read.schema(STATE).parquet(path)
        every = spark.read.schema(STATE + ", batch long").parquet(f"{output}/state").where(F.col("batch") <= batch_id)
        now = drift_of(mine, training_shares, scaler).withColumn("scope", F.lit("batch"))
        so_far = drift_of(merged(every), training_shares, scaler).withColumn("scope", F.lit("so far"))
        rows = now.unionByName(so_far).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{output}/drift/batch={batch_id}")

    return _started(stream, write, checkpoint, available_now)


def _started(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- windows that close -------------------------------------------------------------

_WINDOW_STATE = "window_start timestamp, name string, n long"


def start_closing_windows(
    stream: DataFrame, label: str, output: str, checkpoint: str, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Each event-time window once, when it closes, and the rows that came after that.

    The watermark of a batch is the latest time of all batches before it less
    ``lateness``. Rows of windows that end by then are late: they are written
    to ``output``/late with their time and class, and counted per batch in
    ``output``/batches. The others are added to the open windows, which a batch
    takes from the folder of the batch before it and leaves in its own, so
    state is the open windows and a replay changes nothing. Windows that end by
    the next watermark go to ``output``/windows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], _WINDOW_STATE)
        latest = None
        if batch_id:
            before = spark.read.schema(_WINDOW_STATE).parquet(f"{output}/open/batch={batch_id - 1}")
            latest = spark.read.parquet(f"{output}/batches/batch={batch_id - 1}").first()["latest"]
        step = F.expr(f"INTERVAL {lateness}")
        rows = batch.select(F.col(time).alias("ts"), F.col(ident(label)).alias("name")).withColumn("window_start", F.window("ts", width)["start"])
        end = F.col("window_start") + F.expr(f"INTERVAL {width}")
        late = F.lit(False) if latest is None else F.coalesce(end <= F.lit(latest) - step, F.lit(False))
        kept = rows.withColumn("late", late)
        kept.where("late").select("ts", F.col("name").alias(label)).write.mode("overwrite").parquet(f"{output}/late/batch={batch_id}")
        # one row per window and class of the batch
        counted = kept.groupBy("window_start", "name", "late").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{output}/counts/batch={batch_id}")
        counts = spark.read.parquet(f"{output}/counts/batch={batch_id}")
        facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("late_rows"), F.max("latest").alias("latest"))
        facts = facts.withColumn("latest", F.greatest("latest", F.lit(latest).cast("timestamp")))
        facts.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{output}/batches/batch={batch_id}")
        reached = spark.read.parquet(f"{output}/batches/batch={batch_id}").first()["latest"]
        fresh = counts.where("not late").select("window_start", "name", "n")
        every = before.unionByName(fresh).groupBy("window_start", "name").agg(F.sum("n").alias("n"))
        closed = F.lit(False) if reached is None else F.coalesce(end <= F.lit(reached) - step, F.lit(False))
        every.where(~closed).coalesce(1).write.mode("overwrite").parquet(f"{output}/open/batch={batch_id}")
        _window_health(every.where(closed)).coalesce(1).write.mode("overwrite").parquet(f"{output}/windows/batch={batch_id}")
        if batch_id > 1:  # a replay needs the batch before it only
            remove_folder(spark, f"{output}/open/batch={batch_id - 2}")

    return _started(stream, write, checkpoint, available_now)


def _window_health(counts: DataFrame) -> DataFrame:
    attack = is_attack(F.col("name"))
    totals = counts.groupBy("window_start").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("attacks"), F.count_if(attack).alias("attack_types"))
    ratio = share(F.col("attacks"), F.col("rows"))
    return totals.withColumn("attack_share", ratio).withColumn("status", health_status(F.col("attack_share"), F.col("attack_types")))
