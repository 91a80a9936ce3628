import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import forest_search, linear_training
from flowlens.operators.linear_training import Weights, stored_batches, sums, train_minibatch, train_variance_reduced

FEATURES = [f"f{i}" for i in range(4)]
CLASSES = ["a", "b", "c"]


def _points(n=900, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[y] * 1.5
    return x, y, rng.uniform(0.5, 2, n)


def _table(spark, x, y, w):
    rows = [(i, *map(float, a), CLASSES[k], float(v)) for i, (a, k, v) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["id", *FEATURES, "kind", "weight"])


@pytest.fixture(scope="module")
def points(spark):
    x, y, w = _points()
    return x, y, w, stored_batches(_table(spark, x, y, w), "id", FEATURES, "kind", CLASSES, "weight", batch_rows=200)


def test_batches_hold_every_row_once(spark, points):
    x, y, w, stored = points
    assert (stored.batches, stored.rows) == (5, 900)
    rows = stored.data.collect()
    assert sorted(r["x"][0] for r in rows) == sorted(x[:, 0].tolist()) and {r["batch"] for r in rows} == set(range(5))


def test_sums_equal_numpy(points):
    x, y, w, stored = points
    weights = Weights(np.random.default_rng(2).normal(size=(3, 5)))
    got = sums(stored.data, 4, 3, weights, curved=True)
    p = weights.probabilities(x)
    off = (p - np.eye(3)[y]) * w[:, None]
    one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    np.testing.assert_allclose(got.gradient, off.T @ one, rtol=1e-9)
    np.testing.assert_allclose(got.loss, -(w * np.log(p[np.arange(900), y])).sum(), rtol=1e-9)
    for k in range(3):
        np.testing.assert_allclose(got.curvature[k], (one * (w * p[:, k] * (1 - p[:, k]))[:, None]).T @ one, rtol=1e-9)
    want = np.zeros((3, 3))
    np.add.at(want, (y, p.argmax(axis=1)), 1)
    assert got.rows == 900 and np.array_equal(got.confusion, want)
    empty = sums(stored.data.where("batch = 99"), 4, 3, weights)
    assert empty.rows == 0 and not empty.gradient.any()


def test_minibatch_steps_equal_a_plain_loop(points):
    x, y, w, stored = points
    trained = train_minibatch(stored, stored.data, epochs=3)
    rng = np.random.default_rng(42)
    matrix = rng.uniform(-0.5, 0.5, (3, 5))
    rows = stored.data.collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["batch"], []).append([*r["x"], r["y"], r["w"]])
    first = second = np.zeros_like(matrix)
    step, losses = 0, []
    for _ in range(3):
        loss = 0.0
        for b in rng.permutation(5):
            part = np.array(parts[b])
            px, py, pw = part[:, :4], part[:, 4].astype(int), part[:, 5]
            p = Weights(matrix).probabilities(px)
            loss += -(pw * np.log(p[np.arange(len(py)), py])).sum() / pw.sum() * len(py)
            off = (p - np.eye(3)[py]) * pw[:, None]
            g = off.T @ np.concatenate([px, np.ones((len(px), 1))], axis=1) / pw.sum()
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            matrix = matrix * (1 - 0.01 * 1e-4) - 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        losses.append(loss / 900)
    np.testing.assert_allclose([e.train_loss for e in trained.history], losses, rtol=1e-9)
    if trained.best_epoch == 3:
        np.testing.assert_allclose(trained.weights.matrix, matrix, rtol=1e-9)


def test_stops_early_and_restores_the_best(points):
    x, y, w, stored = points
    trained = train_minibatch(stored, stored.data, epochs=60, patience=2, delta=0.02)
    scores = [e.val_f1 for e in trained.history]
    best, at = None, 0
    for epoch, f1 in enumerate(scores, 1):
        if best is None or f1 > best + 0.02:
            best, at = f1, epoch
    assert trained.best_epoch == at and len(scores) == min(60, at + 2)
    got = sums(stored.data, 4, 3, trained.weights)
    assert linear_training.macro_f1(got.confusion) == pytest.approx(best)


def test_rate_falls_on_a_plateau(points, monkeypatch):
    monkeypatch.setattr(linear_training, "RATE_THRESHOLD", 1.0)  # nothing counts as better
    trained = train_minibatch(points[3], points[3].data, epochs=15, patience=99)
    rates = [e.rate for e in trained.history]
    assert rates[0] == 0.01 and rates[-1] < 0.01 and sorted(rates, reverse=True) == rates


def test_variance_reduced_reaches_the_least_objective(spark, points):
    from flowlens.operators import models

    x, y, w, stored = points
    for penalty in (1e-1, 1e-3):
        weights, history = train_variance_reduced(stored, penalty)
        rows = models.training_rows(_table(spark, x, y, w), FEATURES, "kind", CLASSES, weight="weight")
        least = models.fit_logistic(rows, 500, penalty, tol=1e-12).summary.objectiveHistory[-1]
        assert min(p.objective for p in history) == pytest.approx(least, abs=1e-5)
        model = weights.model(spark)
        assert (model.numClasses, model.numFeatures) == (3, 4)


def test_macro_f1_counts_seen_labels_only():
    assert linear_training.macro_f1(np.array([[2, 0, 0], [0, 2, 0], [0, 0, 0]])) == 1.0
    assert linear_training.macro_f1(np.array([[1, 1], [0, 0]])) == pytest.approx(1 / 3)
    assert linear_training.macro_f1(np.zeros((2, 2))) == 0.0


# --- forests whose trees are shared -------------------------------------------------


def _plain_split(bins, y, weight, count, drawn, min_leaf, classes):
    """Best (feature, edge) of one node by trying all."""
    def purity(mask):
        sums = np.array([weight[mask & (y == k)].sum() for k in range(classes)])
        return (sums**2).sum() / sums.sum() if sums.sum() else 0.0

    best = None
    for place, f in enumerate(drawn):
        for edge in range(forest_search.BINS):
            left = bins[:, f] <= edge
            if count[left].sum() >= min_leaf and count[~left].sum() >= min_leaf:
                gain = purity(left) + purity(~left) - purity(np.ones(len(y), bool))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, place, edge)
    return best


@pytest.mark.parametrize("min_leaf", [1, 4])
def test_splits_equal_trying_all(min_leaf):
    rng = np.random.default_rng(6)
    for _ in range(20):
        n, nodes, classes = 60, 3, 3
        bins = rng.integers(0, 5, (n, 4)).astype(np.uint8)
        y, node, count = rng.integers(0, classes, n), rng.integers(0, nodes, n), rng.integers(1, 3, n).astype(float)
        weight = count * rng.uniform(0.5, 2, classes)[y]
        subset = np.array([rng.permutation(4)[:2] for _ in range(nodes)])
        found = forest_search._best_splits(*forest_search._cells(bins, node, y, weight, count, subset, classes), nodes, 2, min_leaf)
        got = {int(a): (int(b), int(c)) for a, b, c in zip(*found)}
        for k in range(nodes):
            at = node == k
            want = _plain_split(bins[at], y[at], weight[at], count[at], subset[k], min_leaf, classes)
            if want is None or want[0] < 1e-7:
                assert k not in got
                continue
            left = bins[at][:, subset[k][got[k][0]]] <= got[k][1]
            again = _plain_split(bins[at], y[at], weight[at], count[at], [subset[k][got[k][0]]], min_leaf, classes)
            assert again[0] == pytest.approx(want[0]) and count[at][left].sum() >= min_leaf


def test_a_shallow_tree_is_the_top_of_a_deep_one():
    x, y, _ = _points(400)
    bins = np.clip((x * 4 + 16), 0, 31).astype(np.uint8)
    args = (bins[:300], y[:300], np.ones(3), bins[300:], 1)
    both = forest_search.tree_votes(*args, [2, 8], np.random.default_rng(3))
    short = forest_search.tree_votes(*args, [2], np.random.default_rng(3))
    assert np.array_equal(both[0], short[0]) and not np.array_equal(both[0], both[1])
    np.testing.assert_allclose(both[1].sum(axis=1), 1)


def test_search_scores_prefixes_and_twins(spark):
    x, y, w = _points(600)
    table = _table(spark, x, y, w).withColumn("fold", F.pmod("id", F.lit(3)))
    rows = forest_search.binned(table, FEATURES, ["kind", "fold"])
    settings = [
        {"numTrees": n, "maxDepth": d, "minSplit": s, "minInstancesPerNode": 1}
        for n, d, s in ((30, 6, 2), (30, 6, 10), (60, 6, 2), (30, None, 2), (30, 30, 5))
    ]
    got = {(r["draw"], r["fold"]): r["weighted_f1"] for r in forest_search.search(rows, "kind", CLASSES, settings, 30).collect()}
    assert len(got) == 15 and all(0.6 < v <= 1 for v in got.values())
    for fold in range(3):
        assert got[0, fold] == pytest.approx(got[1, fold]) and got[3, fold] == pytest.approx(got[4, fold])
        alone = forest_search.search(rows, "kind", CLASSES, settings[:1], 30).collect()
        assert {r["fold"]: r["weighted_f1"] for r in alone}[fold] == pytest.approx(got[0, fold])


def test_bins_follow_the_order_of_values(spark):
    table = spark.range(1000).selectExpr("double(id) as a", "double(id % 3) as b", "double(1) as c", "'k' as kind")
    rows = forest_search.binned(table, ["a", "b", "c"], ["kind"]).collect()
    a = sorted(r["bins"][0] for r in rows)
    assert a[0] == 0 and a[-1] == forest_search.BINS - 1 and max(a.count(v) for v in set(a)) < 60
    assert len({r["bins"][1] for r in rows}) == 3 and {r["bins"][2] for r in rows} == {0}
