from unittest.mock import MagicMock

import pytest

from flowlens.operators import models
from flowlens.queries import scores


def test_depth_beyond_the_limit_is_an_error():
    assert models.tree_depth(None) == models.DEEPEST and models.tree_depth(20) == 20
    with pytest.raises(ValueError):
        models.tree_depth(31)


def test_registered_forests_have_the_library_settings(monkeypatch):
    fitted, searched = [], []
    table = MagicMock(features=["x"])
    for name in ("fine_table", "coarse_table", "_split_metrics", "stratified_subset", "_search_rows"):
        monkeypatch.setattr(scores, name, lambda *a: table)
    monkeypatch.setattr(scores, "shared", lambda spark, sf_dir, name, build: build())
    monkeypatch.setattr(scores, "F", MagicMock())
    monkeypatch.setattr(models, "balanced_rows", lambda *a: None)
    monkeypatch.setattr(models, "fit_forest", lambda rows, params: fitted.append(params))
    monkeypatch.setattr(models, "tune_forest", lambda *a, **b: searched.append((a[3:], b)) or ({"numTrees": 300}, "tried"))
    scores.fine_forest(None, "")
    scores.binary_forest(None, "")
    assert fitted == [models.FINE_FOREST, {"numTrees": 300}] and scores.forest_search(None, "") == "tried"
    assert searched == [((), {})] * 2
