import datetime as dt
import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from flowlens.operators import cleaning
from flowlens.operators.scoring import Preprocessing, linear_model
from flowlens.plans.score import score_json
from flowlens.sources.tables import Bundle
from flowlens.streaming.drift import STATE, batch_state, drift_of, merged, start_closing_windows, start_drift

NAN, INF = float("nan"), float("inf")


def test_distinct_rows_by_value(spark):
    rows = [
        ("a", 1.0, None, "x"), ("b", None, 1.0, "x"), ("c", 1.0, None, "x"), ("d", 0.0, 2.0, "y"), ("e", -0.0, 2.0, "y"),
        ("f", NAN, INF, None), ("g", NAN, INF, None), ("h", NAN, INF, ""), ("i", None, None, None), ("j", None, None, None),
    ]
    df = spark.createDataFrame(rows * 1, "id string, p double, q double, r string")
    kept = cleaning.drop_duplicate_rows(df, "id")
    assert kept.columns == df.columns and sorted(r["id"] for r in kept.collect()) == ["a", "b", "d", "f", "h", "i"]
    summary = cleaning.duplicate_summary(df, "id").first()
    assert (summary["rows_before"], summary["rows_removed"], summary["removed_pct"]) == (10, 4, 40.0)


def test_rows_of_one_digest_must_agree(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    forced = df.groupBy(F.lit(1)).agg(*cleaning._first_and_last(["v"])).where(cleaning._agreed(["v"]))
    with pytest.raises(Exception, match="128-bit"):
        forced.collect()


def test_a_hot_row_is_combined_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr("id", "IF(id % 3 = 0, 1.0D, id * 1.0D) as v", "0.0D as w")
    assert cleaning.drop_duplicate_rows(df, "id").count() == 200_000 - 66_667 + 1 - 1  # id 1 has the value of the hot row


def _bundle(spark, features, classes):
    weights = [[float((i + j) % 3 - 1) for j in range(len(features))] for i in range(len(classes))]
    scaler = {f: (0.0, 1.0) for f in features}
    return Bundle(Preprocessing(features, scaler), {"fine": linear_model(spark, weights, [0.0] * len(classes))}, {"fine": classes})


def test_json_lines_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"Rate": 1, "IAT": 2}\n\nnot json\n{"Rate": "x"}\n')
    (folder / "b.json").write_text('{"foo": 1}\n{"IAT": 5, "Rate": null}')
    run = score_json(spark, str(folder), _bundle(spark, ["Rate", "IAT", "Min"], ["a", "b", "c"]), "fixed", str(tmp_path / "out"))
    assert sorted(r["index"] for r in run.predictions.collect()) == [0, 2, 4]
    assert {(r["index"], r["line"], r["reject_reason"]) for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()} == {
        (1, "not json", "not a JSON object"), (3, '{"foo": 1}', "no expected feature")}
    note = run.adjustments.first()
    assert (note["rows_adjusted"], note["invalid_values_replaced"], note["missing_features_filled"]) == (3, 6, ["Min"])
    summary = json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0])
    assert (summary["total_rows"], summary["filename"]) == (3, "in")
    (tmp_path / "none.json").write_text("\n\n")
    with pytest.raises(ValueError, match="no records"):
        score_json(spark, str(tmp_path / "none.json"), _bundle(spark, ["Rate"], ["a", "b"]), "fixed")


def test_states_add_up_and_drift_is_found(spark):
    rows = [("BENIGN", 1.0), ("XSS", 3.0), ("XSS", None), ("XSS", INF), ("NEW", 100.0)]
    df = spark.createDataFrame(rows, "label string, Rate double")
    parts = [batch_state(df.where(c), "label", ["Rate"]) for c in ("label = 'XSS'", "label <> 'XSS'")]
    got = {(r["kind"], r["name"]): (r["n"], r["total"], r["squares"]) for r in merged(parts[0].unionByName(parts[1])).collect()}
    assert got == {(r["kind"], r["name"]): (r["n"], r["total"], r["squares"]) for r in batch_state(df, "label", ["Rate"]).collect()}
    assert got["feature", "Rate"] == (3, 104.0, 10010.0) and got["class", "XSS"][0] == 3
    shares = spark.createDataFrame([("BENIGN", 0.2), ("XSS", 0.5), ("OLD", 0.3)], "class string, share double")
    row = drift_of(batch_state(df, "label", ["Rate"]), shares, {"Rate": (1.0, 2.0)}).first()
    assert (row["rows"], row["attacks"], row["attack_types"], row["status"]) == (5, 4, 2, "Warning")
    assert row["class_shift"] == pytest.approx(0.3) and row["class_alerts"] == 3
    assert row["feature_shift"] == pytest.approx((104 / 3 - 1) / 2) and row["feature_alerts"] == 1
    empty = drift_of(spark.createDataFrame([], STATE), shares, {"Rate": (1.0, 2.0)}).first()
    assert (empty["rows"], empty["status"], empty["class_alerts"]) == (0, None, 3)


def test_drift_of_batches_is_replay_safe(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        rows = [("BENIGN" if i % 2 else "XSS", float(i + k)) for i in range(10)]
        spark.createDataFrame(rows, "label string, Rate double").coalesce(1).write.mode("append").parquet(str(folder))
    shares = spark.createDataFrame([("BENIGN", 0.5), ("XSS", 0.5)], "class string, share double")
    for checkpoint in ("one", "two"):  # the second run replays every batch
        stream = spark.readStream.schema("label string, Rate double").option("maxFilesPerTrigger", 1).parquet(str(folder))
        start_drift(stream, "label", ["Rate"], shares, {"Rate": (4.5, 1.0)}, str(tmp_path / "out"), str(tmp_path / checkpoint), True).awaitTermination()
        rows = {(r["batch_id"], r["scope"]): r for r in spark.read.parquet(str(tmp_path / "out/drift")).collect()}
        assert len(rows) == 6
        assert [round(rows[k, "batch"]["feature_shift"], 6) for k in range(3)] == [0.0, 1.0, 2.0]
        assert [(rows[k, "so far"]["rows"], round(rows[k, "so far"]["feature_shift"], 6)) for k in range(3)] == [(10, 0.0), (20, 0.5), (30, 1.0)]


def test_windows_close_once_and_late_rows_are_kept(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    batches = [
        [(0, "XSS"), (30, "BENIGN"), (70, "XSS")],  # reaches 1:10, so 1:00 is the watermark: the first hour closes
        [(50, "XSS"), (75, "DOS"), (200, "BENIGN")],  # 0:50 is late; reaches 3:20
        [(65, "XSS"), (190, "XSS"), (400, "XSS")],  # 1:05 is late
    ]
    for rows in batches:
        table = spark.createDataFrame([(day + dt.timedelta(minutes=m), c) for m, c in rows], "ts timestamp, c string")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, c string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    start_closing_windows(stream, "c", out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    minute = lambda ts: int((ts - day).total_seconds() // 60)
    windows = {minute(r["window_start"]): (r["rows"], r["attacks"], r["attack_types"]) for r in spark.read.parquet(f"{out}/windows").collect()}
    assert windows == {0: (2, 1, 1), 60: (2, 2, 2), 180: (2, 1, 1)}
    late = sorted((minute(r["ts"]), r["c"], r["batch"]) for r in spark.read.schema("ts timestamp, c string, batch long").parquet(f"{out}/late").collect())
    assert late == [(50, "XSS", 1), (65, "XSS", 2)]
    facts = {r["batch_id"]: (r["rows"], r["late_rows"]) for r in spark.read.parquet(f"{out}/batches").collect()}
    assert facts == {0: (3, 0), 1: (3, 1), 2: (3, 1)}
    # what is left open is the last window only
    assert [minute(r["window_start"]) for r in spark.read.parquet(f"{out}/open/batch=2").collect()] == [360]


def test_values_below_the_fitted_range_count_as_its_lower_end(spark):
    from flowlens.operators.transforms import apply_log

    df = spark.createDataFrame([(-9.0, -9.0), (-2.0, 0.0), (1.0, 3.0), (None, None)], "a double, b double")
    rows = apply_log(df, {"a": -2.0, "b": 1.0}).collect()
    assert [r["a"] for r in rows[:3]] == pytest.approx([math.log(2), math.log(2), math.log(5)]) and rows[3]["a"] is None
    assert [r["b"] for r in rows[:3]] == pytest.approx([0.0, 0.0, math.log(4)]) and rows[3]["b"] is None


def test_fine_medians_of_training_rows(spark):
    from flowlens.plans.prepare import prepare_fine

    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else float(i), float(i % 3)) for i in range(400)]
    raw = spark.createDataFrame(rows, "id long, Label string, x double, y double")
    every, train = (prepare_fine(raw, "id", target=400, floor=1, cap=400, fit_scope=s) for s in ("all", "train"))
    kept = [r["x"] for r in raw.join(train.data.where("split = 'train'").select("id"), "id").collect() if r["x"] is not None]
    assert train.medians["x"] == statistics.median(kept)
    assert every.medians["x"] == statistics.median(r[2] for r in rows if r[2] is not None)
    assert sorted(r["id"] for r in every.data.where("split = 'test'").collect()) == sorted(r["id"] for r in train.data.where("split = 'test'").collect())
