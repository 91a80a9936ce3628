"""Steps that read a large table once: rows that a step computes are counted as they are computed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import models
from flowlens.plans import prepare
from flowlens.plans.prepare import Prepared
from flowlens.queries import scores
from flowlens.schema import FAMILIES, FAMILY_LABEL, FEATURES_FINE, LABEL, SPLIT
from flowlens.workspace import discard, is_stored, materialize

ROWS = 240


@pytest.fixture
def counted(spark):
    """Rows of two classes with a feature that counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return random.Random(i).gauss(i % 2, 1.0)

    made = F.udf(value, "double")
    kinds = F.when(F.col("id") % 2 == 0, FAMILIES[0]).otherwise(FAMILIES[1])
    base = materialize(spark.range(ROWS).select(F.col("id").alias(scores.ROW_ID), kinds.alias(FAMILY_LABEL), F.lit("train").alias(SPLIT)), "base")
    yield base.withColumn("x", made(scores.ROW_ID)), seen
    discard(base)


def test_search_rows_read_the_table_once(counted):
    df, seen = counted
    rows = models.search_rows(df, scores.ROW_ID, ["x"], [FAMILY_LABEL], FAMILY_LABEL, ROWS)
    assert rows.count() == ROWS and seen.value == ROWS
    assert sorted(r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [80, 80, 80]


def test_forest_rows_are_read_once(counted):
    df, seen = counted
    table = Prepared(df, df, ["x"], None, {}, [])
    model = scores._fitted_forest(table, FAMILY_LABEL, FAMILIES, {"numTrees": 2, "maxDepth": 3})
    assert model.getNumTrees == 2 and seen.value == ROWS


def test_a_candidate_is_scored_once_a_row(spark, counted):
    df, seen = counted
    rows = models.balanced_rows(df, ["x"], FAMILY_LABEL, FAMILIES)
    stored = materialize(rows, "rows")
    model = models.fit_logistic(stored, 5, 0.1)
    before = seen.value
    loss, f1 = models._validate(model, rows, FAMILIES)
    assert seen.value - before == ROWS
    scored = model.transform(stored).collect()
    wanted = -sum(r["weight"] * math.log(r["probability"][int(r["label"])]) for r in scored) / sum(r["weight"] for r in scored)
    assert loss == pytest.approx(wanted, rel=1e-12) and 0 < f1 <= 1


def _recorded(monkeypatch):
    names = []

    def record(df, name, *more):
        names.append(name)
        return materialize(df, name, *more)

    monkeypatch.setattr(prepare, "materialize", record)
    return names


def test_a_stored_table_with_ids_is_not_stored_again(spark, flow_table, monkeypatch):
    raw = flow_table.where("l_orderkey % 7 = 0").select(scores.ROW_ID, LABEL, *[F.col(f"`{f}`") for f in FEATURES_FINE])
    stored = materialize(raw, "raw")
    assert is_stored(stored) and not is_stored(raw)
    names = _recorded(monkeypatch)
    from_stored = prepare.prepare_fine(stored, scores.ROW_ID)
    assert "raw" not in names
    plain = prepare.prepare_fine(raw, scores.ROW_ID)
    assert "raw" in names
    assert sorted(map(str, from_stored.data.select(scores.ROW_ID, SPLIT).collect())) == sorted(map(str, plain.data.select(scores.ROW_ID, SPLIT).collect()))
    names.clear()
    prepare.prepare_coarse(stored, scores.ROW_ID)
    assert names == ["logged", "split"]  # a split reads cleaned rows


def test_flows_of_models_are_joined_once(spark, flow_table, monkeypatch):
    calls = []
    monkeypatch.setattr(scores, "flows", lambda *a: calls.append(a) or flow_table.limit(5))
    tables = [scores._raw(spark, "one folder") for _ in range(2)]
    assert len(calls) == 1 and tables[0].count() == 5 and tables[0] is tables[1]
