"""Steps that read every row of their table, whatever its size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.operators import linear_training, models
from flowlens.plans.prepare import Prepared
from flowlens.queries import scores
from flowlens.schema import FAMILIES, FAMILY_LABEL, SPLIT
from flowlens.workspace import is_stored


def _table(spark, rows):
    kind = F.element_at(F.array(*[F.lit(f) for f in FAMILIES[:3]]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(rows).select(
        F.col("id").alias(scores.ROW_ID), kind.alias(FAMILY_LABEL), F.lit("train").alias(SPLIT),
        (F.col("id") % 3 + F.rand(1)).alias("x"), F.rand(2).alias("y"))


def test_a_forest_is_fitted_on_all_training_rows(spark, monkeypatch):
    given = []
    monkeypatch.setattr(models, "fit_forest", lambda rows, params: given.append(rows.count()))
    table = _table(spark, 160_000)
    held = table.limit(50).withColumn(SPLIT, F.lit("val"))
    scores._fitted_forest(Prepared(table.union(held), table, ["x", "y"], None, {}, []), FAMILY_LABEL, FAMILIES, {"numTrees": 1})
    assert given == [160_000]


def test_groups_hold_all_trees():
    assert models.tree_groups(300, 1_000, 1 << 27) == [300]
    assert models.tree_groups(300, 0, 10) == [300]
    groups = models.tree_groups(200, 28_800_000, 1 << 30)
    assert sum(groups) == 200 and max(groups) * 28_800_000 <= 1 << 30
    assert models.tree_groups(3, 1_000, 10) == [1, 1, 1]


def test_trees_of_a_large_table_are_fitted_in_groups(spark, tmp_path, monkeypatch):
    rows = models.balanced_rows(_table(spark, 400), ["x", "y"], FAMILY_LABEL, FAMILIES)
    monkeypatch.setattr(models, "FOREST_CELLS", 400)  # one tree a core
    params = {"numTrees": 2 * spark.sparkContext.defaultParallelism + 1, "maxDepth": 4}
    model = models.fit_forest(rows, params)
    assert model.getNumTrees == params["numTrees"] == len({t.toDebugString for t in model.trees})
    assert model.numFeatures == 2 and model.featureImportances.toArray().sum() == pytest.approx(1)
    scored = model.transform(rows)
    assert scored.where("prediction = label").count() > 380
    # a row's votes are those of all trees
    row = scored.first()
    votes = sum(t.predictProbability(row["features"]).toArray() for t in model.trees)
    assert row["probability"].toArray() == pytest.approx(votes / votes.sum())
    model.save(str(tmp_path / "forest"))
    again = models.RandomForestClassificationModel.load(str(tmp_path / "forest"))
    assert again.getNumTrees == model.getNumTrees and again.transform(rows).select("probability").collect() == scored.select("probability").collect()


def test_blocks_keep_every_bit():
    rng = np.random.default_rng(5)
    odd = np.array([0.0, -0.0, np.nan, np.inf, 5e-324])
    for rows in (1, 2, 700, 3_000):
        columns = np.stack([rng.normal(size=rows), odd[rng.integers(0, 5, rows)], rng.integers(0, 300, rows) / 7, np.full(rows, 2.0)])
        block = linear_training._encoded(columns)
        assert linear_training._decoded(pa.py_buffer(block), 4).tobytes() == columns.tobytes()
    assert len(block) < columns.nbytes / 2


def test_a_pass_reads_blocks_and_not_single_rows(spark):
    rows = spark.range(60_000).select("id", F.rand(3).alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit("b").alias("c"), F.lit(1.5).alias("w"))
    stored = linear_training.stored_batches(rows, "id", ["x", "y"], "c", ["a", "b"], "w", batch_rows=30_000)
    assert stored.batches == 2 and stored.blocks.count() < 60_000 / 1_000
    assert stored.data.select("y", "w").distinct().collect() == [(1, 1.5)]
    wanted = rows.agg(F.sum("x"), F.sum("y")).first()
    for data in (stored.blocks, stored.data):
        got = linear_training.sums(data, 2, 2, linear_training.Weights(np.zeros((2, 3))))
        assert got.rows == 60_000 and got.gradient[0] == pytest.approx([0.75 * wanted[0], 0.75 * wanted[1], 45_000])


def test_flows_that_nobody_else_reads_go_before_the_table_is_split(spark, flow_table, monkeypatch):
    made = []
    stored_flows = scores._stored_flows
    monkeypatch.setattr(scores, "flows", lambda *a: flow_table.where("l_orderkey % 7 = 0"))
    monkeypatch.setattr(scores, "_stored_flows", lambda *a: made.append(stored_flows(*a)) or made[-1])
    alone = scores.coarse_table(spark, "folder of one reader")
    assert not is_stored(made[0]) and alone.data.count() > 0
    raw = scores._raw(spark, "folder of two readers")
    both = scores.coarse_table(spark, "folder of two readers")
    assert is_stored(raw) and raw.count() == both.data.count() == alone.data.count()
    scored = scores.coarse_table(spark, "folder of scored flows", True)
    assert len(made) == 3 and is_stored(made[2]) and scored.data.count() == raw.count()
