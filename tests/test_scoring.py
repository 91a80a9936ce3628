import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.probabilities import argmax, confidence, log_loss, top_classes
from flowlens.operators import models
from flowlens.operators.sanitize import sanitize
from flowlens.operators.scoring import Preprocessing, apply_model, feature_vector, linear_model, score_fine_linear
from flowlens.plans.prepare import fine_checks, prepare_coarse, prepare_fine
from flowlens.plans.score import score_csv
from flowlens.plans.train import evaluate, train_coarse_logistic, train_fine_logistic
from flowlens.schema import (
    BINARY_CLASSES, BINARY_LABEL, CLASSES_FINE, FAMILIES, FAMILY_LABEL, FEATURES_COARSE, FEATURES_FINE, LABEL, ident,
)
from flowlens.sources import tables


def test_linear_model_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(200, 5)), rng.normal(size=(4, 5)), rng.normal(size=4)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double, d double, e double")
    model = linear_model(spark, w.tolist(), b.tolist())
    vectors = df.select("i", feature_vector([F.col(c) for c in "abcde"]).alias("v"))
    scored = apply_model(vectors, model, "v", "fine").orderBy("i").collect()
    got = np.array([r["fine_proba"] for r in scored])
    z = x @ w.T + b
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert [int(r["fine_index"]) for r in scored] == want.argmax(axis=1).tolist()
    assert "Python" not in apply_model(vectors, model, "v", "fine")._jdf.queryExecution().executedPlan().toString()
    model.save(str(tmp_path / "linear"))
    again = type(model).load(str(tmp_path / "linear"))
    np.testing.assert_array_equal(again.coefficientMatrix.toArray(), w)
    assert apply_model(vectors.where("i < 0"), model, "v", "fine").collect() == []


def test_ties_and_unknown_classes(spark):
    df = spark.createDataFrame([([0.25, 0.25, 0.25, 0.25],), ([0.1, 0.6, 0.1, 0.2],)], "p array<double>")
    classes = ["a", "b", "c", "d"]
    rows = df.select(
        argmax(F.col("p")).alias("i"), top_classes(F.col("p"), classes).alias("top"),
        confidence(F.col("p"), F.lit("zzz"), classes).alias("unknown"), confidence(F.col("p"), F.lit("b"), classes).alias("known"),
        log_loss(F.col("p"), F.lit(1)).alias("loss"),
    ).collect()
    assert rows[0]["i"] == 0 and [t["class"] for t in rows[0]["top"]] == ["d", "c", "b"]
    assert rows[1]["i"] == 1 and [t["class"] for t in rows[1]["top"]] == ["b", "d", "c"]
    assert (rows[1]["unknown"], rows[1]["known"]) == (0.1, 0.6)
    assert rows[1]["loss"] == pytest.approx(-math.log(0.6))


def test_null_features_count_as_the_training_mean(spark):
    prep = Preprocessing(["a", "b"], {"a": (10.0, 2.0), "b": (math.log1p(3), 1.0)}, {"b": 0.0})
    df = spark.createDataFrame([(None, None), (10.0, 3.0)], "a double, b double")
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(prep.inputs())]).collect()
    assert tuple(rows[0]) == (0.0, 0.0) and tuple(rows[1]) == pytest.approx((0.0, 0.0))
    scored = score_fine_linear(df, prep, [[1.0, 0.0], [0.0, 1.0]], [0.0, 1.0], ["n", "y"], [])
    assert {r["predicted_class"] for r in scored.collect()} == {"y"}
    assert scored.first()["confidence"] == 0.7311


@pytest.fixture(scope="module")
def raw(flow_table):
    return flow_table.dropDuplicates(["flow_id"]).select("flow_id", LABEL, *[F.col(ident(f)) for f in FEATURES_FINE])


@pytest.fixture(scope="module")
def fine(raw):
    return prepare_fine(raw, "flow_id", target=3000, floor=60, cap=300)


@pytest.fixture(scope="module")
def coarse(raw):
    return prepare_coarse(raw, "flow_id")


def test_fine_table(fine):
    sizes = {r["split"]: r["count"] for r in fine.data.groupBy("split").count().collect()}
    n = sum(sizes.values())
    held = -(-n // 5)
    assert sizes == {"train": n - held, "val": held - -(-held // 2), "test": -(-held // 2)}
    assert sorted(fine.dropped) == ["IPv", "LLC", "SMTP", "Telnet"] and len(fine.features) == 35
    train = fine.data.where("split = 'train'").agg(F.avg("IAT"), F.stddev_pop("IAT")).first()
    assert tuple(train) == pytest.approx((0.0, 1.0), abs=1e-9)
    done = fine_checks(fine, CLASSES_FINE, 3000)
    assert all(r["passed"] for r in done["clean"].collect())
    assert done["shift"].first()["passed"]
    assert {r["present"] for r in done["presence"].collect()} == {34}


def test_coarse_table(coarse, raw):
    assert coarse.features == FEATURES_COARSE
    assert coarse.data.count() == raw.count()
    assert {r[0] for r in coarse.data.select(BINARY_LABEL).distinct().collect()} == set(BINARY_CLASSES)
    assert coarse.prep.log_minimums["Min"] < 0 and "TCP" not in coarse.prep.log_minimums


def test_coarse_table_fitted_on_training_rows(raw):
    table = prepare_coarse(raw, "flow_id", fit_scope="train", drop_duplicates=True)
    train = table.data.where("split = 'train'").agg(F.avg("Rate"), F.stddev_pop("Rate")).first()
    assert tuple(train) == pytest.approx((0.0, 1.0), abs=1e-9)
    with pytest.raises(ValueError):
        prepare_coarse(raw, "flow_id", fit_scope="test")


def test_rows_are_numbered_without_a_row_id(raw):
    table = prepare_fine(raw.drop("flow_id"), None, target=3000, floor=60, cap=300)
    again = prepare_fine(raw.drop("flow_id"), None, target=3000, floor=60, cap=300)
    assert table.data.count() == again.data.count()
    assert table.data.select("row_id").distinct().count() == table.data.count()


@pytest.fixture(scope="module")
def logistic(fine):
    return train_fine_logistic(fine)[0]


def test_fine_logistic_and_bundle(spark, fine, logistic, raw, tmp_path):
    result = evaluate(logistic, fine, LABEL, CLASSES_FINE)
    scores = {r["split"]: r["accuracy"] for r in result.by_split.collect()}
    assert scores["train"] > 0.8 and scores["test"] > 0.7
    assert result.test_report.count() == 34 and result.gap.count() == 4
    path = str(tmp_path / "bundle")
    tables.save_bundle(tables.Bundle(fine.prep, {"fine": logistic}, {"fine": CLASSES_FINE}), path, spark)
    bundle = tables.load_bundle(spark, path)
    assert bundle.prep == fine.prep and bundle.classes == {"fine": CLASSES_FINE}
    source = str(tmp_path / "input.csv")
    raw.drop("flow_id", "Number").coalesce(1).write.option("header", True).csv(source)
    run = score_csv(spark, source, bundle, "logistic", str(tmp_path / "out"))
    rows = run.predictions.collect()
    assert sorted(r["index"] for r in rows) == list(range(raw.count()))
    for r in rows[:50]:
        top = r["top_3_predictions"]
        assert len(top) == 3 and top[0]["class"] == r["predicted_class"] and top[0]["probability"] == r["confidence"]
    assert run.adjustments.first()["missing_features_filled"] == ["Number"]
    assert run.adjustments.first()["rows_adjusted"] == raw.count()
    summary = json.loads((spark.read.text(str(tmp_path / "out") + "/summary").first())[0])
    assert (summary["filename"], summary["model_used"], summary["total_rows"]) == ("input.csv", "logistic", raw.count())


def test_probabilities_sum_to_one(fine, logistic):
    rows = models.training_rows(fine.data, fine.features, LABEL, CLASSES_FINE, keep=["split"])
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    off = logistic.transform(rows).where(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9)
    assert off.count() == 0


def test_retry_keeps_the_last_attempt(fine):
    train = models.balanced_rows(fine.data.where("split = 'train'"), fine.features, LABEL, CLASSES_FINE)
    model, attempts = models.fit_fine_logistic(train, [1, 2])
    assert model.summary.totalIterations == 2 and [(a.limit, a.converged) for a in attempts] == [(1, False), (2, False)]


def test_candidate_selection_stops_when_stale(spark, coarse):
    model, history = train_coarse_logistic(coarse, BINARY_LABEL, [(1e-4, 5), (1e3, 1), (1e3, 1), (1e3, 1)])
    assert len(history) == 4 and history[0].val_f1 == max(h.val_f1 for h in history)
    train = models.balanced_rows(coarse.data.where("split = 'train'"), coarse.features, BINARY_LABEL, BINARY_CLASSES, clipped=True)
    _, history = models.select_logistic(train, train, BINARY_CLASSES, [(1e-4, 5), (1e3, 1), (1e3, 1), (1e3, 1)], patience=2)
    assert len(history) == 3
    assert models.objective_history(spark, model).count() >= 2
    importance = models.logistic_importance(spark, model, coarse.features)
    assert importance.count() == 28
    assert models.top_features(importance).count() == 20


def test_coarse_scoring_with_two_models(spark, coarse, raw):
    from flowlens.operators.scoring import score_coarse

    binary, _ = train_coarse_logistic(coarse, BINARY_LABEL, [(1e-4, 10)])
    family, _ = train_coarse_logistic(coarse, FAMILY_LABEL, [(1e-4, 10)])
    tidy = sanitize(raw, coarse.features, keep=["flow_id"]).data
    rows = score_coarse(tidy, coarse.prep, binary, family, BINARY_CLASSES, FAMILIES, ["flow_id"])
    assert rows.count() == raw.count()
    bad = rows.where("confidence_binary < 0.5 OR confidence_attack < 0.125 OR confidence_attack > 1")
    assert bad.count() == 0


def test_forest_and_search(spark, coarse):
    train = coarse.data.where("split = 'train'")
    model = models.fit_forest(models.balanced_rows(train, coarse.features, FAMILY_LABEL, FAMILIES), {"numTrees": 8, "maxDepth": 6})
    importance = models.forest_importance(spark, model, coarse.features)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    binned = models.search_rows(train, "flow_id", coarse.features, [FAMILY_LABEL, BINARY_LABEL], FAMILY_LABEL, 1000, folds=2)
    best, table = models.tune_forest(
        binned, FAMILY_LABEL, FAMILIES, {"numTrees": [3], "maxDepth": [2, 5], "minSplit": [2], "minInstancesPerNode": [1]}, draws=2)
    rows = table.collect()
    assert len(rows) == 2 and best["maxDepth"] == max(rows, key=lambda r: r["weighted_f1"])["depth"]
    assert {(r["folds"], r["scored_rows"]) for r in rows} == {(2, 1000)}


def test_draws_are_distinct_and_repeatable():
    draws = models.draw_settings(models.FOREST_GRID)
    assert len(draws) == 12 and len({tuple(d.items()) for d in draws}) == 12
    assert draws == models.draw_settings(models.FOREST_GRID)
    assert models.forest({"maxDepth": None}).getMaxDepth() == 30


def test_sample_files(spark, flow_table, tmp_path):
    records, truth = tables.demo_sample(flow_table, "flow_id", FEATURES_FINE, LABEL)
    tables.write_sample(records, truth, str(tmp_path))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "records")).collect()]
    assert len(lines) == 20 and LABEL not in lines[0] and "index" not in lines[0]
    assert sorted(r["index"] for r in spark.read.json(str(tmp_path / "truth")).collect()) == list(range(20))


def test_split_files_prune(spark, flow_table, tmp_path):
    path = str(tmp_path / "splits")
    tables.write_splits(flow_table.select("flow_id", "split", "IAT"), path, ["IAT"])
    one = tables.read_splits(spark, path, "test")
    assert one.count() == flow_table.where("split = 'test'").count()
    assert dict(one.dtypes)["IAT"] == "float"
    assert "split=test" in one.inputFiles()[0] or all("split=" in f for f in one.inputFiles())
