"""Train and evaluate the classifiers on a prepared table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.linear_training import (
    BATCH_ROWS, EPOCHS, MOST_BATCHES, Trained, stored_batches, train_minibatch, train_variance_reduced,
)
from ..operators.models import (
    FINE_FOREST, Attempt, balanced_rows, fit_fine_logistic, fit_forest, score_splits, search_rows, select_logistic, training_rows,
    tune_forest, unit_penalty,
)
from ..schema import (
    BINARY_CLASSES, BINARY_LABEL, CLASSES_FINE, FAMILIES, FAMILY_LABEL, LABEL, SPLIT, TUNE_SUBSET_ROWS,
)
from .prepare import ROW_ID, Prepared

# Passes of the second solver.
VARIANCE_REDUCED_PASSES = 200
# Regularisation strengths and iteration limits tried for the coarse models.
COARSE_LOGISTIC_GRID = [(1e-6, 100), (1e-5, 100), (1e-4, 100), (1e-3, 100)]


@dataclass
class Evaluation:
    """One confusion table per split and the reports computed from it."""

    counts: DataFrame
    by_split: DataFrame
    gap: DataFrame
    test_report: DataFrame


def evaluate(model: Model, prepared: Prepared, label: str, classes: list[str]) -> Evaluation:
    rows = training_rows(prepared.data, prepared.features, label, classes, keep=[SPLIT])
    scored = score_splits(model, rows, classes, [SPLIT])
    counts = metrics.confusion_counts(scored, "truth", "predicted", [SPLIT])
    by_split = metrics.summary_metrics(counts, [SPLIT])
    test = counts.where(F.col(SPLIT) == "test").drop(SPLIT)
    return Evaluation(counts, by_split, metrics.overfitting_table(by_split), metrics.class_report(test, classes=classes))


def _part(prepared: Prepared, split: str) -> DataFrame:
    return prepared.data.where(F.col(SPLIT) == split)


def train_fine_logistic(
    prepared: Prepared, row_id: str = ROW_ID, classes: list[str] = CLASSES_FINE, iterations: list[int] | None = None, passes: int = VARIANCE_REDUCED_PASSES,
) -> tuple[Model, list[Attempt]]:
    """L-BFGS with growing limits, then the variance-reduced solver; the first that converges, else the last."""
    train = _part(prepared, "train")
    rows = balanced_rows(train, prepared.features, LABEL, classes)
    penalty = unit_penalty(rows)
    model, attempts = fit_fine_logistic(rows, iterations, penalty)
    if not attempts[-1].converged:
        weighted = metrics.with_class_weight(train, metrics.class_weights(train, LABEL), LABEL, "__weight")
        batches = stored_batches(weighted, row_id, prepared.features, LABEL, classes, "__weight")
        weights, history = train_variance_reduced(batches, penalty, passes)
        attempts.append(Attempt("variance-reduced", passes, len(history), len(history) < passes, min(p.objective for p in history)))
        model = weights.model(train.sparkSession)
    return model, attempts


def train_fine_forest(prepared: Prepared, classes: list[str] = CLASSES_FINE, params: dict | None = None) -> Model:
    return fit_forest(balanced_rows(_part(prepared, "train"), prepared.features, LABEL, classes), params or FINE_FOREST)


def train_coarse_minibatch(
    prepared: Prepared, label: str, row_id: str = ROW_ID, epochs: int = EPOCHS, batch_rows: int = BATCH_ROWS, most_batches: int = MOST_BATCHES,
) -> tuple[Model, Trained]:
    """Mini-batch model of the epoch that validated best; classes weigh as in the training rows."""
    classes = BINARY_CLASSES if label == BINARY_LABEL else FAMILIES
    train = _part(prepared, "train")
    weights = metrics.clipped_class_weights(train, label, len(classes))
    parts = [metrics.with_class_weight(part, weights, label, "__weight") for part in (train, _part(prepared, "val"))]
    stored = [
        stored_batches(part, row_id, prepared.features, label, classes, "__weight", batch_rows, most)
        for part, most in zip(parts, (most_batches, 1))
    ]
    trained = train_minibatch(stored[0], stored[1].blocks, epochs)
    return trained.weights.model(train.sparkSession), trained


def train_coarse_logistic(prepared: Prepared, label: str, grid: list[tuple[float, int]] | None = None):
    """Full-batch alternative: the penalty with the best validation macro F1, and the tried candidates."""
    classes = BINARY_CLASSES if label == BINARY_LABEL else FAMILIES
    train = balanced_rows(_part(prepared, "train"), prepared.features, label, classes, clipped=True)
    val = balanced_rows(_part(prepared, "val"), prepared.features, label, classes, clipped=True)
    return select_logistic(train, val, classes, grid or COARSE_LOGISTIC_GRID)


def coarse_search_rows(prepared: Prepared, row_id: str = ROW_ID, subset_rows: int = TUNE_SUBSET_ROWS) -> DataFrame:
    """Binned rows for the searches of both labels, stratified by family."""
    train = _part(prepared, "train")
    return search_rows(train, row_id, prepared.features, [BINARY_LABEL, FAMILY_LABEL], FAMILY_LABEL, subset_rows)


def train_coarse_forest(
    prepared: Prepared, label: str, row_id: str, tune: bool = True,
    subset_rows: int = TUNE_SUBSET_ROWS, grid: dict[str, list] | None = None, params: dict | None = None, binned_rows: DataFrame | None = None,
) -> Model:
    """Forest with tuned settings (or the given ones) on all training rows; ``binned_rows`` of ``coarse_search_rows`` serve both labels."""
    classes = BINARY_CLASSES if label == BINARY_LABEL else FAMILIES
    train = _part(prepared, "train")
    best = params or {}
    if tune:
        binned_rows = binned_rows if binned_rows is not None else coarse_search_rows(prepared, row_id, subset_rows)
        best, _ = tune_forest(binned_rows, label, classes, grid)
    return fit_forest(balanced_rows(train, prepared.features, label, classes), best)


COARSE_LABELS = {BINARY_LABEL: BINARY_CLASSES, FAMILY_LABEL: FAMILIES}
