import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlens.operators.monitoring import health
from flowlens.streaming import health as stream_health
from flowlens.streaming.scoring import csv_stream, record_stream, start_rejects, start_scoring


def scorer(df, keep):
    return df.select(*keep, (F.coalesce(F.col("Rate"), F.lit(0.0)) > 1).alias("hit"))


def test_json_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(f'{{"id": "{n}-{i}", "Rate": {i}}}' for i in range(4)))
    stream = record_stream(spark, str(tmp_path / "in"), ["Rate", "IAT"], ["id"])
    for _ in range(2):  # the second run finds nothing new
        start_scoring(stream, scorer, ["id"], str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    rows = {r["id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {f"{n}-{i}": i > 1 for n in range(3) for i in range(4)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,Rate,Label\na,3,XSS\nb,x,XSS\n")
    stream = csv_stream(spark, str(tmp_path / "in"), ["id", "Rate", "Label"], ["Rate"], ["id"])
    start_scoring(stream, scorer, ["id"], str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    assert {r["id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": True, "b": False}


def test_rejected_records_are_not_scored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"id": "a", "Rate": 3}', "not json at all", '{"foo": 1}', "[1, 2]", '{"id": "b", "Rate": null}', '{"id": "c", "Rate": 2']
    (tmp_path / "in" / "0.json").write_text("\n".join(lines))
    stream = record_stream(spark, str(tmp_path / "in"), ["Rate", "IAT"], ["id"])
    start_scoring(stream, scorer, ["id"], str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    start_rejects(stream, str(tmp_path / "bad"), str(tmp_path / "ck-bad"), True).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}
    rejects = {r["line"]: r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    broken = "not a JSON object"
    assert rejects == {lines[1]: broken, lines[2]: "no expected feature", lines[3]: broken, lines[5]: broken}


def test_csv_stream_refuses_other_headers_and_long_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,Rate,Label\na,3,XSS\nb,2,XSS,9\nc,5\nd,2,XSS,\n")
    stream = csv_stream(spark, str(tmp_path / "in"), ["id", "Rate", "Label"], ["Rate"], ["id"])
    start_scoring(stream, scorer, ["id"], str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    start_rejects(stream, str(tmp_path / "bad"), str(tmp_path / "ck-bad"), True).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "c"}
    assert {r["line"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"b,2,XSS,9", "d,2,XSS,"}
    (tmp_path / "in" / "b.csv").write_text("Rate,id,Label\n7,z,XSS\n")
    with pytest.raises(StreamingQueryException):
        start_scoring(stream, scorer, ["id"], str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    assert "7" not in {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def events(spark, path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=10 * i), "BENIGN" if i % 3 else f"A{i % 6}") for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, predicted_class string").repartition(2).write.parquet(path)
    return spark.readStream.schema("ts timestamp, predicted_class string").parquet(path)


def test_batch_health(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"))
    stream_health.start_batch_health(stream, "predicted_class", str(tmp_path / "out"), str(tmp_path / "ck"), True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).first()
    want = health(spark.read.parquet(str(tmp_path / "in"))).first()
    assert all(got[c] == want[c] for c in want.asDict())


def test_windows_complete_and_append(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"))
    windows = stream_health.windowed_health(stream, "predicted_class")
    for mode in ("complete", "append"):
        stream_health.start_windowed_health(windows, str(tmp_path / mode), str(tmp_path / f"ck-{mode}"), mode, True).awaitTermination()
    full = spark.read.parquet(str(tmp_path / "complete")).collect()
    closed = spark.read.parquet(str(tmp_path / "append")).collect()
    assert len(full) == 10 and sum(r["rows"] for r in full) == 60
    assert all(r["rows"] == 6 and r["attacks"] == 2 and r["attack_types"] == 2 and r["status"] == "Warning" for r in full)
    # The window that may still receive rows is held back.
    assert len(closed) == 9 and {r["window_start"] for r in closed} < {r["window_start"] for r in full}
