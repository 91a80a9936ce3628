"""Classifier training on Spark ML."""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import decode, encode
from ..functions.probabilities import log_loss
from ..schema import SEED, TUNE_DRAWS, TUNE_FOLDS, ident
from ..workspace import discard, materialize
from .forest_search import binned, search
from .metrics import class_weights, clipped_class_weights, summary_metrics, with_class_weight
from .sampling import stratified_folds, stratified_subset
from .scoring import feature_vector

# Training settings and the search space of the forest.
FINE_FOREST = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 10}
LOGISTIC_ITERATIONS = [1000, 2000]
FOREST_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, 30, None],
    "minSplit": [2, 5, 10],
    "minInstancesPerNode": [1, 2, 4],
}
EARLY_STOP_PATIENCE = 10
EARLY_STOP_DELTA = 0.001

# Spark ML grows trees to at most this depth; it stands for "no limit".
DEEPEST = 30

#: Cells (row x tree, eight bytes each: how often a tree drew a row and its node there) that a fit of some trees may hold for each core.
FOREST_CELLS = 1 << 27


def training_rows(df: DataFrame, features: list[str], label: str, classes: list[str], keep: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Feature vector, label index and, if named, the weight and other columns."""
    kept = [F.col(ident(k)) for k in (keep or [])]
    if weight:
        kept.append(F.col(weight).alias("weight"))
    vector = feature_vector([F.col(ident(f)).cast("double") for f in features])
    return df.select(
        vector.alias("features"), F.col(ident(label)).alias("class"),
        encode(F.col(ident(label)), classes).cast("double").alias("label"), *kept,
    )


def balanced_rows(df: DataFrame, features: list[str], label: str, classes: list[str], clipped: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Training rows weighted by inverse class size."""
    weights = clipped_class_weights(df, label, len(classes)) if clipped else class_weights(df, label)
    weighted = with_class_weight(df, weights, label, "__weight")
    return training_rows(weighted, features, label, classes, keep, "__weight")


def fit_logistic(rows: DataFrame, max_iter: int, reg_param: float, tol: float = 1e-6) -> Model:
    return LogisticRegression(
        family="multinomial", featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=max_iter, regParam=reg_param, elasticNetParam=0.0, standardization=False, tol=tol,
    ).fit(rows)


@dataclass
class Attempt:
    solver: str
    limit: int
    iterations: int
    converged: bool
    objective: float


def unit_penalty(rows: DataFrame) -> float:
    """Spark divides the loss by the sum of weights, so a unit penalty on the summed loss is 1 / sum(weight)."""
    return 1.0 / rows.agg(F.sum("weight")).first()[0]


def fit_fine_logistic(rows: DataFrame, iterations: list[int] | None = None, penalty: float | None = None) -> tuple[Model, list[Attempt]]:
    """L2-regularised multinomial model, retried with more iterations until it converges; the last attempt if none does."""
    penalty = penalty or unit_penalty(rows)
    model, attempts = None, []
    for limit in iterations or LOGISTIC_ITERATIONS:
        model = fit_logistic(rows, limit, penalty)
        used = model.summary.totalIterations
        attempts.append(Attempt("l-bfgs", limit, used, used < limit, float(model.summary.objectiveHistory[-1])))
        if attempts[-1].converged:
            break
    return model, attempts


def attempts_table(spark: SparkSession, attempts: list[Attempt]) -> DataFrame:
    rows = [(i + 1, a.solver, a.limit, a.iterations, a.converged, a.objective) for i, a in enumerate(attempts)]
    return spark.createDataFrame(rows, "attempt int, solver string, max_iter int, iterations int, converged boolean, objective double")


@dataclass
class Candidate:
    reg_param: float
    max_iter: int
    train_loss: float
    val_loss: float
    train_f1: float
    val_f1: float


def _validate(model: Model, rows: DataFrame, classes: list[str]) -> tuple[float, float]:
    """Weighted loss and macro F1 of a model on a split."""
    scored = model.transform(rows).select(
        "class", "label", "weight", decode(F.col("prediction"), classes).alias("guess"),
        vector_to_array("probability").alias("p"),
    )
    judged = scored.select("class", "guess", "weight", log_loss(F.col("p"), F.col("label")).alias("loss"))
    # a row per pair of classes, so that the model runs once a row for both scores
    cells = materialize(judged.groupBy(F.col("class").alias("truth"), F.col("guess").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("loss") * F.col("weight")).alias("loss"), F.sum("weight").alias("weight")), "cells")
    loss = cells.agg(F.sum("loss") / F.sum("weight")).first()[0]
    f1 = summary_metrics(cells.select("truth", "predicted", "n")).first()["f1"]
    discard(cells)
    return loss, f1


def select_logistic(
    train: DataFrame, val: DataFrame, classes: list[str], grid: list[tuple[float, int]],
    patience: int = EARLY_STOP_PATIENCE, delta: float = EARLY_STOP_DELTA,
) -> tuple[Model, list[Candidate]]:
    """Fit candidates in turn and keep the best validation macro F1.

    A candidate wins when it improves by more than ``delta``; the search ends
    after ``patience`` candidates without improvement.
    """
    best, best_f1, stale, history = None, None, 0, []
    for reg_param, max_iter in grid:
        model = fit_logistic(train, max_iter, reg_param)
        train_loss, train_f1 = _validate(model, train, classes)
        val_loss, val_f1 = _validate(model, val, classes)
        history.append(Candidate(reg_param, max_iter, train_loss, val_loss, train_f1, val_f1))
        if best_f1 is None or val_f1 > best_f1 + delta:
            best, best_f1, stale = model, val_f1, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best, history


def history_table(spark: SparkSession, history: list[Candidate]) -> DataFrame:
    rows = [(i + 1, c.reg_param, c.max_iter, c.train_loss, c.val_loss, c.train_f1, c.val_f1) for i, c in enumerate(history)]
    return spark.createDataFrame(
        rows, "step int, reg_param double, max_iter int, train_loss double, val_loss double, train_f1 double, val_f1 double"
    )


def objective_history(spark: SparkSession, model: Model) -> DataFrame:
    """Training loss after each iteration."""
    rows = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, loss double")


def tree_depth(depth: int | None) -> int:
    """None for unlimited depth is Spark's deepest; a larger number is an error, not a smaller tree."""
    if depth is not None and depth > DEEPEST:
        raise ValueError(f"Spark's trees have at most {DEEPEST} levels, not {depth}")
    return DEEPEST if depth is None else depth


def forest(params: dict, weight: str | None = "weight", seed: int = SEED) -> RandomForestClassifier:
    """Random forest estimator; unlimited depth becomes Spark's deepest.

    Splits of a node need no minimum size of their own in Spark, so the leaf
    minimum alone applies. Node ids are cached and cut by the checkpoint
    folder, so that deep trees survive lost executors.
    """
    rf = RandomForestClassifier(
        featuresCol="features", labelCol="label", seed=seed, featureSubsetStrategy="sqrt",
        numTrees=params.get("numTrees", 100), maxDepth=tree_depth(params.get("maxDepth")),
        minInstancesPerNode=params.get("minInstancesPerNode", 1), maxMemoryInMB=1024, cacheNodeIds=True,
    )
    return rf.setWeightCol(weight) if weight else rf


def tree_groups(trees: int, rows: int, cells: int) -> list[int]:
    """Sizes of the groups in which ``trees`` trees are fitted, so that rows x trees of a group stay within ``cells``."""
    groups = min(trees, max(1, -(-trees * rows // cells)))
    return [trees // groups + (i < trees % groups) for i in range(groups)]


def fit_forest(rows: DataFrame, params: dict, seed: int = SEED) -> Model:
    """Forest of all trees on all rows.

    Spark holds a few bytes for each row and tree of a fit. Trees know nothing of each other, so those of a
    large table are fitted some at a time, each group on every row and with a seed of its own.
    """
    whole = forest(params, seed=seed)
    cells = FOREST_CELLS * rows.sparkSession.sparkContext.defaultParallelism
    groups = tree_groups(whole.getNumTrees(), rows.count(), cells)
    if len(groups) == 1:
        return whole.fit(rows)
    return joined_forest([forest(params | {"numTrees": n}, seed=seed + i).fit(rows) for i, n in enumerate(groups)])


def joined_forest(parts: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several that were fitted on the same features and classes."""
    sc = SparkSession.active().sparkContext
    trees = [tree for part in parts for tree in part._java_obj.trees()]
    array = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = parts[0]._java_obj
    uid = sc._jvm.org.apache.spark.ml.util.Identifiable.randomUID("rfc")
    made = sc._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        uid, array, max(p.numFeatures for p in parts), max(p.numClasses for p in parts))
    first.copyValues(made, sc._jvm.org.apache.spark.ml.param.ParamMap())
    made.set(made.numTrees(), len(trees))
    model = RandomForestClassificationModel(made)
    model._transfer_params_from_java()
    return model


def draw_settings(grid: dict[str, list], draws: int = TUNE_DRAWS, seed: int = SEED) -> list[dict]:
    """Seeded draw of distinct settings from the full grid."""
    names = list(grid)
    every = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(every, min(draws, len(every)))


def search_rows(
    df: DataFrame, row_id: str, features: list[str], labels: list[str], stratum: str, subset_rows: int,
    folds: int = TUNE_FOLDS, seed: int = SEED,
) -> DataFrame:
    """At most ``subset_rows`` rows, stratified, dealt to stratified folds and binned; stored once for searches of all ``labels``."""
    # the folds and bins read the few rows five times, and the table only once for them
    subset = materialize(stratified_subset(df, row_id, stratum, subset_rows, seed), "subset")
    folded = stratified_folds(subset, row_id, stratum, folds, seed, "fold")
    rows = binned(folded, features, [*labels, "fold"])
    discard(subset)
    return rows


def tune_forest(
    rows: DataFrame, label: str, classes: list[str], grid: dict[str, list] | None = None, draws: int = TUNE_DRAWS, seed: int = SEED,
) -> tuple[dict, DataFrame]:
    """Randomized search by weighted F1 over the folds of ``search_rows``.

    Returns the best settings (the first of equals) and a table of all tried ones.
    """
    settings = draw_settings(grid or FOREST_GRID, draws, seed)
    for s in settings:
        tree_depth(s["maxDepth"])
    by_fold = search(rows, label, classes, settings, DEEPEST, seed)
    # a row per draw
    found = by_fold.groupBy("draw").agg(F.avg("weighted_f1").alias("f1"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("folds")).collect()
    scores = {r["draw"]: r for r in found}
    best = max(range(len(settings)), key=lambda i: (scores[i]["f1"], -i))
    table = search_table(rows.sparkSession, settings, scores)
    return settings[best], table


def search_table(spark: SparkSession, settings: list[dict], scores: dict) -> DataFrame:
    return spark.createDataFrame(
        [(i, s["numTrees"], s["maxDepth"], s.get("minSplit"), s["minInstancesPerNode"], scores[i]["folds"], scores[i]["rows"], float(scores[i]["f1"]))
         for i, s in enumerate(settings)],
        "draw int, trees int, depth int, min_split int, min_leaf int, folds long, scored_rows long, weighted_f1 double",
    )


def score_splits(model: Model, rows: DataFrame, classes: list[str], keep: list[str]) -> DataFrame:
    """Truth and prediction of every row, with the kept columns."""
    return model.transform(rows).select(
        *[F.col(ident(k)) for k in keep], F.col("class").alias("truth"), decode(F.col("prediction"), classes).alias("predicted"),
    )


def forest_importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def logistic_importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    """Absolute weight of class 1 for two classes, else the mean over classes."""
    matrix = [[float(w) for w in row] for row in model.coefficientMatrix.toArray()]
    long = spark.createDataFrame(
        [(f, k, row[j]) for k, row in enumerate(matrix) for j, f in enumerate(features)],
        "feature string, class int, weight double",
    )
    if len(matrix) <= 2:
        long = long.where(F.col("class") == len(matrix) - 1)
    return long.groupBy("feature").agg(F.avg(F.abs("weight")).alias("importance"))


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    """Importance table of a forest or a linear model."""
    made = forest_importance if hasattr(model, "featureImportances") else logistic_importance
    return made(spark, model, features)
