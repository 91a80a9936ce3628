import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import checks, distributions, metrics, monitoring


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "t string, p string")


def brute(pairs, classes):
    report = {}
    for c in classes:
        hits = sum(t == p == c for t, p in pairs)
        support, predicted = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        precision = hits / predicted if predicted else 0.0
        recall = hits / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        report[c] = (precision, recall, f1, support)
    return report


@pytest.mark.parametrize("listed", [True, False])
def test_report_matches_brute_force(spark, listed):
    rng = random.Random(3)
    pairs = [(rng.choice("abc"), rng.choice("abd")) for _ in range(400)] + [("a", "a")] * 800
    classes = ["a", "b", "c", "d", "e"] if listed else ["a", "b", "c", "d"]
    counts = metrics.confusion_counts(frame(spark, pairs), "t", "p")
    got = metrics.class_report(counts, classes=classes if listed else None).collect()
    want = brute(pairs, classes)
    assert {r["class"] for r in got} == set(classes)
    for r in got:
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx(want[r["class"]])
    summary = metrics.summary_metrics(counts).first()
    seen = {c: v for c, v in brute(pairs, ["a", "b", "c", "d"]).items()}
    assert summary["f1"] == pytest.approx(sum(v[2] for v in seen.values()) / 4)
    assert summary["weighted_f1"] == pytest.approx(sum(v[2] * v[3] for v in seen.values()) / len(pairs))
    assert summary["accuracy"] == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))


def test_confusion_matrix_lists_all_classes(spark):
    df = frame(spark, [("a", "a"), ("a", "b"), ("a", "b"), ("b", "x")])
    rows = {r["truth"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()}
    assert rows == {"a": (1, 2, 0), "b": (0, 0, 0), "c": (0, 0, 0)}
    shares = {(r["truth"], r["predicted"]): r["pct"] for r in metrics.confusion_shares(metrics.confusion_counts(df, "t", "p"), digits=1).collect()}
    assert shares == {("a", "a"): 33.3, ("a", "b"): 66.7, ("b", "x"): 100.0}


@pytest.mark.parametrize("gap, verdict", [
    (0.05, "no significant overfitting"), (0.0500001, "possible overfitting"),
    (-0.05, "no significant overfitting"), (-0.0500001, "validation above training"), (0.0, "no significant overfitting"),
])
def test_overfit_limits(spark, gap, verdict):
    df = spark.createDataFrame([(gap,)], "g double")
    assert df.select(metrics.overfit_verdict(F.col("g"))).first()[0] == verdict


def test_overfitting_table(spark):
    rows = [("train", 0.9, 0.9, 0.9, 0.9), ("val", 0.8, 0.8, 0.8, 0.7), ("test", 0.7, 0.7, 0.7, 0.7)]
    df = spark.createDataFrame(rows, "split string, accuracy double, precision double, recall double, f1 double")
    table = {r["metric"]: r for r in metrics.overfitting_table(df).collect()}
    assert table["accuracy"]["gap"] == pytest.approx(0.1)
    assert {r["verdict"] for r in table.values()} == {"possible overfitting"}
    title = {r["Split"]: r["F1"] for r in metrics.metrics_table(df).collect()}
    assert title == {"Train": 0.9, "Validation": 0.7, "Test": 0.7}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 2, "Label string")
    weights = {r["Label"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert weights == pytest.approx({"a": 100 / 196, "b": 25.0})
    clipped = {r["Label"]: r["weight"] for r in metrics.clipped_class_weights(df, "Label", 2).collect()}
    assert clipped["b"] == 10.0
    joined = metrics.with_class_weight(df, metrics.class_weights(df))
    assert joined.agg(F.sum("weight")).first()[0] == pytest.approx(100)


def test_share_gap_ignores_one_sided_classes(spark):
    left = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "Label string")
    right = spark.createDataFrame([("a",)] * 6 + [("c",)] * 4, "Label string")
    row = distributions.max_share_difference(left, right, tolerance=0.02).first()
    assert row["max_difference"] == pytest.approx(0.1) and not row["passed"]


def test_checks(spark):
    rows = [("train", "a", 1.0), ("train", "b", 1.0), ("val", "a", float("inf")), ("test", "b", None)]
    df = spark.createDataFrame(rows, "split string, Label string, x double")
    presence = {r["split"]: r["missing_names"] for r in checks.class_presence(df, ["a", "b", "c"]).collect()}
    assert presence == {"train": "c", "val": "b,c", "test": "a,c"}
    clean = checks.clean_splits(df, ["x"])
    assert {r["split"]: r["passed"] for r in clean.collect()} == {"train": True, "val": False, "test": False}
    assert checks.all_passed(clean).first()["passed"] is False
    assert checks.size_ratio(df, 4).first()["verdict"] == "PASS"
    assert checks.size_ratio(df, 5).first()["verdict"] == "WARN"


def mix(spark, benign, attacks):
    rows = [("BENIGN",)] * benign + [(a,) for a, n in attacks.items() for _ in range(n)]
    return spark.createDataFrame(rows, "predicted_class string")


@pytest.mark.parametrize("benign, attacks, status", [
    (87, {"RECON-PORTSCAN": 13}, "Stable"),
    (33, {"DDOS-SYN_FLOOD": 40, "MIRAI-UDPPLAIN": 27}, "Warning"),
    (10, {f"A{i}": 10 for i in range(9)}, "Critical"),
    (60, {f"A{i}": 8 for i in range(5)}, "Critical"),
    (70, {"A": 30}, "Stable"),
    (20, {"A": 80}, "Warning"),
])
def test_health_of_known_mixes(spark, benign, attacks, status):
    row = monitoring.health(mix(spark, benign, attacks)).first()
    assert row["status"] == status
    assert (row["rows"], row["attacks"], row["attack_types"]) == (100, sum(attacks.values()), len(attacks))


def test_empty_batch_has_no_status(spark):
    empty = spark.createDataFrame([], "predicted_class string")
    row = monitoring.health(empty).first()
    assert (row["rows"], row["status"]) == (0, None)
    none = spark.createDataFrame([], "binary_prediction string, confidence_binary double, confidence_attack double")
    row = monitoring.prediction_summary(none).first()
    assert (row["total"], row["attack_pct"], row["mean_binary_confidence"]) == (0, None, None)


def test_prediction_summary(spark):
    rows = [(0, "Benign", "Benign", 0.9, 0.8), (1, "Benign", "Benign", 0.7, 0.6)]
    df = spark.createDataFrame(rows, "index long, binary_prediction string, attack_family string, confidence_binary double, confidence_attack double")
    row = monitoring.prediction_summary(df).first()
    assert (row["attacks"], row["mean_attack_confidence"], row["attack_pct"]) == (0, None, 0.0)
    assert row["mean_binary_confidence"] == pytest.approx(0.8)
    widths = {r["class"]: (r["rows"], r["width"]) for r in monitoring.binary_distribution(df).collect()}
    assert widths == {"Attack": (0, 0.0), "Benign": (2, 100.0)}


def test_rank_ties_keep_first_appearance(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (1, "a", 1.0), (2, "a", 0.5), (3, "b", 1.0), (4, None, 1.0)],
                               "index long, attack_family string, confidence_attack double")
    rows = sorted(monitoring.family_predictions(df).collect(), key=lambda r: r["rank"])
    assert [(r["class"], r["rows"], r["mean_confidence"]) for r in rows] == [("b", 2, 1.0), ("a", 2, 0.75), ("Unknown", 1, 1.0)]


def test_drift(spark):
    train = spark.createDataFrame([("a",)] * 9 + [("b",)], "predicted_class string")
    batch = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "predicted_class string")
    rows = {r["class"]: r for r in monitoring.class_drift(batch, distributions.class_shares(train, "predicted_class"), "predicted_class").collect()}
    assert rows["a"]["difference"] == pytest.approx(0.4) and rows["a"]["alert"]
    shift = monitoring.feature_drift(spark.createDataFrame([(10.0, 1.0), (14.0, 1.0)], "x double, y double"), {"x": (4.0, 2.0), "y": (1.0, 1.0)})
    assert {r["feature"]: (r["shift"], r["alert"]) for r in shift.collect()} == {"x": (4.0, True), "y": (0.0, False)}


def test_truth_by_index(spark):
    p = spark.createDataFrame([(0, "a"), (1, "b")], "index long, predicted_class string")
    t = spark.createDataFrame([(0, "a"), (1, "a")], "index long, true_class string")
    assert Counter(r["correct"] for r in metrics.compare_to_truth(p, t).collect()) == {True: 1, False: 1}


def test_drift_alerts_for_new_and_vanished_classes(spark):
    train = spark.createDataFrame([("a",)] * 9 + [("gone",)], "predicted_class string")
    batch = spark.createDataFrame([("a",)] + [("new",)] * 9, "predicted_class string")
    rows = {r["class"]: r for r in monitoring.class_drift(batch, distributions.class_shares(train, "predicted_class"), "predicted_class", tolerance=1.0).collect()}
    assert rows["new"]["training_share"] == 0 and rows["new"]["difference"] == pytest.approx(0.9) and rows["new"]["alert"]
    assert rows["gone"]["batch_share"] == 0 and rows["gone"]["alert"] and not rows["a"]["alert"]
