"""Queries over scoring, model training and streams."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import encode
from ..functions.probabilities import log_loss
from ..operators import linear_training, metrics, models
from ..operators.distributions import class_shares
from ..operators.sampling import stratified_subset  # noqa: F401  (tests replace it by this name)
from ..operators.sanitize import COARSE_LABELS, FINE_LABELS, sanitize
from ..operators.scoring import apply_model, feature_vector, linear_model, score_coarse, score_coarse_linear, score_fine, score_fine_linear
from ..plans.flows import ROW_ID, flows
from ..plans.prepare import Prepared, prepare_coarse, prepare_fine
from ..plans.score import score_json
from ..plans.train import coarse_search_rows, evaluate, train_coarse_logistic, train_coarse_minibatch, train_fine_logistic
from ..schema import (
    BINARY_CLASSES, BINARY_LABEL, CLASSES_FINE, FAMILIES, FAMILY_LABEL, FEATURES_COARSE, FEATURES_FINE, LABEL, SPLIT,
    MAX_CAP, MIN_SAMPLES, TARGET_TOTAL, TUNE_SUBSET_ROWS, ident,
)
from ..sources import tables
from ..streaming import health as stream_health
from ..streaming.drift import start_closing_windows, start_drift
from ..sources.records import REASON
from ..streaming.scoring import record_stream, start_rejects, start_scoring
from ..workspace import discard, materialize, new_path
from .common import (
    PACKED, clean_cte, coarse_logged_cte, coarse_preprocessing, fine_preprocessing, fixed_weights,
    json_folder, probability_ctes, scaler_cte,
)
from .registry import is_shared, query, shared
from .sqltext import over_flows, quoted, stacked, text

# --- scoring with fixed weights -------------------------------------------------

_FINE_P = [clean_cte(), *probability_ctes(FEATURES_FINE, "clean", 34, "f")]
_TOP = """top AS (SELECT flow_id, k, p, row_number() OVER (PARTITION BY flow_id ORDER BY p DESC, k DESC) AS place FROM fp),
best AS (SELECT flow_id, k, p, row_number() OVER (PARTITION BY flow_id ORDER BY p DESC, k) AS place FROM fp)"""


def _fine_scored(spark: SparkSession, sf_dir: str, keep: list[str], rounded: bool = False) -> DataFrame:
    tidy = sanitize(flows(spark, sf_dir), FEATURES_FINE, FINE_LABELS, keep).data
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    return score_fine_linear(tidy, fine_preprocessing(spark, sf_dir), weights, bias, CLASSES_FINE, keep, rounded)


@query("f08_top_classes", over_flows("""
SELECT flow_id, CAST(place AS INT) AS place, label AS class, round(p, 6) AS probability FROM top JOIN classes ON idx = k WHERE place <= 3""", *_FINE_P, _TOP))
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("top_3_predictions")
    # rows of places: of a column to explode, Spark asks first whether it is empty, and so runs the model twice
    places = F.array(*[
        F.struct(F.lit(i + 1).alias("place"), top[i]["class"].alias("class"), F.round(top[i]["probability"], 6).alias("probability")) for i in range(3)])
    return _fine_scored(spark, sf_dir, [ROW_ID]).select(ROW_ID, F.inline(places))


@query("f09_confidence", over_flows("""
SELECT label AS predicted_class, count(*) AS rows, round(min(p), 6) AS low, round(max(p), 6) AS high FROM best JOIN classes ON idx = k
WHERE place = 1 GROUP BY label""", *_FINE_P, _TOP))
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fine_scored(spark, sf_dir, [ROW_ID]).groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.min("confidence"), 6).alias("low"), F.round(F.max("confidence"), 6).alias("high"))


@query("m09_fine_scoring", over_flows("""
SELECT b.flow_id, c.label AS predicted_class, round(b.p, 6) AS confidence, t1.label AS first_class, round(a1.p, 6) AS first_probability,
  t2.label AS second_class, round(a2.p, 6) AS second_probability, t3.label AS third_class, round(a3.p, 6) AS third_probability
FROM best b JOIN classes c ON c.idx = b.k
JOIN top a1 ON a1.flow_id = b.flow_id AND a1.place = 1 JOIN classes t1 ON t1.idx = a1.k
JOIN top a2 ON a2.flow_id = b.flow_id AND a2.place = 2 JOIN classes t2 ON t2.idx = a2.k
JOIN top a3 ON a3.flow_id = b.flow_id AND a3.place = 3 JOIN classes t3 ON t3.idx = a3.k WHERE b.place = 1""", *_FINE_P, _TOP))
def fine_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("top_3_predictions")
    columns = []
    for i, name in enumerate(("first", "second", "third")):
        columns += [top[i]["class"].alias(f"{name}_class"), F.round(top[i]["probability"], 6).alias(f"{name}_probability")]
    return _fine_scored(spark, sf_dir, [ROW_ID]).select(ROW_ID, "predicted_class", F.round("confidence", 6).alias("confidence"), *columns)


_COARSE_P = [
    clean_cte(), coarse_logged_cte(), *probability_ctes(FEATURES_COARSE, "logged", 2, "b"), *probability_ctes(FEATURES_COARSE, "logged", 8, "c"),
    "bb AS (SELECT flow_id, k, p, row_number() OVER (PARTITION BY flow_id ORDER BY p DESC, k) AS place FROM bp)",
    "cb AS (SELECT flow_id, k, p, row_number() OVER (PARTITION BY flow_id ORDER BY p DESC, k) AS place FROM cp)",
    "binary_names(k, name) AS (VALUES " + ", ".join(f"({i}, {text(c)})" for i, c in enumerate(BINARY_CLASSES)) + ")",
    "family_names(k, name) AS (VALUES " + ", ".join(f"({i}, {text(c)})" for i, c in enumerate(FAMILIES)) + ")",
]


@query("m10_coarse_scoring", over_flows("""
SELECT bb.flow_id, n.name AS binary_prediction, m.name AS attack_family, round(bb.p, 6) AS confidence_binary, round(cb.p, 6) AS confidence_attack
FROM bb JOIN cb ON cb.flow_id = bb.flow_id AND cb.place = 1 JOIN binary_names n ON n.k = bb.k JOIN family_names m ON m.k = cb.k
WHERE bb.place = 1""", *_COARSE_P))
def coarse_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = sanitize(flows(spark, sf_dir), FEATURES_COARSE, COARSE_LABELS, [ROW_ID]).data
    n = len(FEATURES_COARSE)
    scored = score_coarse_linear(
        tidy, coarse_preprocessing(spark, sf_dir), (*fixed_weights(n, 2), BINARY_CLASSES), (*fixed_weights(n, 8), FAMILIES), [ROW_ID], rounded=False)
    return scored.withColumns({c: F.round(c, 6) for c in ("confidence_binary", "confidence_attack")})


@query("a33_weighted_loss", over_flows("""
SELECT split, round(sum(-ln(p) * w.weight) / sum(w.weight), 6) AS loss FROM fp JOIN (
  SELECT "Label", CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight FROM flows GROUP BY "Label") w
  ON w."Label" = fp."Label" WHERE k = class_idx GROUP BY split""", *_FINE_P))
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    tidy = sanitize(df.withColumnRenamed(LABEL, "truth"), FEATURES_FINE, FINE_LABELS, ["truth", SPLIT]).data
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    vectors = tidy.withColumn("__x", feature_vector(fine_preprocessing(spark, sf_dir).inputs()))
    scored = apply_model(vectors, linear_model(spark, weights, bias), "__x", "fine")
    scored = scored.select(SPLIT, F.col("truth").alias(LABEL), log_loss(F.col("fine_proba"), encode(F.col("truth"), CLASSES_FINE)).alias("loss"))
    weighted = metrics.with_class_weight(scored, metrics.class_weights(df), LABEL)
    return metrics.weighted_loss(weighted, F.col("loss"), F.col("weight"), [SPLIT]).withColumn("loss", F.round("loss", 6))


# --- trained models ---------------------------------------------------------------


def _stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as a model reads them, joined and stored once."""
    columns = [ROW_ID, LABEL, *[F.col(ident(f)) for f in FEATURES_FINE]]
    return materialize(flows(spark, sf_dir).select(*columns), "raw")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored flows for both tables and for scoring."""
    return shared(spark, sf_dir, "raw flows", lambda: _stored_flows(spark, sf_dir))


def fine_table(spark: SparkSession, sf_dir: str) -> Prepared:
    return shared(spark, sf_dir, "fine table", lambda: prepare_fine(_raw(spark, sf_dir), ROW_ID))


def coarse_table(spark: SparkSession, sf_dir: str, flows_again: bool = False) -> Prepared:
    """Coarse table; flows that are not scored again, and that nobody else has, go as soon as it has read them."""

    def build() -> Prepared:
        if flows_again or is_shared(spark, sf_dir, "raw flows"):
            return prepare_coarse(_raw(spark, sf_dir), ROW_ID)
        raw = _stored_flows(spark, sf_dir)
        return prepare_coarse(raw, ROW_ID, last_read=lambda: discard(raw))

    return shared(spark, sf_dir, "coarse table", build)


def _fine_attempts(spark: SparkSession, sf_dir: str) -> tuple[Model, list[models.Attempt]]:
    return shared(spark, sf_dir, "fine logistic", lambda: train_fine_logistic(fine_table(spark, sf_dir), ROW_ID))


def _fine_logistic(spark: SparkSession, sf_dir: str) -> Model:
    return _fine_attempts(spark, sf_dir)[0]


def _coarse_logistic(spark: SparkSession, sf_dir: str, label: str) -> tuple[Model, linear_training.Trained]:
    """Mini-batch model and its epochs."""
    return shared(spark, sf_dir, f"logistic {label}", lambda: train_coarse_minibatch(coarse_table(spark, sf_dir), label, ROW_ID))


def _fitted_forest(t: Prepared, label: str, classes: list[str], params: dict) -> Model:
    """Forest of all training rows.

    A fit reads its rows several times: they are stored first, with the label and the features alone,
    so that the table is read and scaled only once for them.
    """
    columns = [F.col(ident(c)) for c in (label, *t.features)]
    rows = materialize(t.data.where(F.col(SPLIT) == "train").select(*columns), "forest-rows")
    model = models.fit_forest(models.balanced_rows(rows, t.features, label, classes), params)
    discard(rows)
    return model


def _fine_forest(spark: SparkSession, sf_dir: str) -> Model:
    def build() -> Model:
        t = fine_table(spark, sf_dir)
        return _fitted_forest(t, LABEL, CLASSES_FINE, models.FINE_FOREST)

    return shared(spark, sf_dir, "fine forest", build)


def _split_metrics(model: Model, table: Prepared, label: str, classes: list[str]) -> DataFrame:
    return evaluate(model, table, label, classes).by_split


@query("m01_fine_logistic")
def fine_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_metrics(_fine_logistic(spark, sf_dir), fine_table(spark, sf_dir), LABEL, CLASSES_FINE)


@query("m02_binary_logistic")
def binary_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _coarse_logistic(spark, sf_dir, BINARY_LABEL)
    return _split_metrics(model, coarse_table(spark, sf_dir), BINARY_LABEL, BINARY_CLASSES)


@query("m03_family_logistic")
def family_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _coarse_logistic(spark, sf_dir, FAMILY_LABEL)
    return _split_metrics(model, coarse_table(spark, sf_dir), FAMILY_LABEL, FAMILIES)


@query("m04_candidate_selection")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties tried by the full-batch alternative."""
    return models.history_table(spark, train_coarse_logistic(coarse_table(spark, sf_dir), FAMILY_LABEL)[1])


@query("m04_epoch_selection")
def epoch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per epoch of the family model: validation score and whether its weights were kept."""
    return linear_training.epoch_table(spark, _coarse_logistic(spark, sf_dir, FAMILY_LABEL)[1]).select("epoch", "val_f1", "kept")


@query("m05_training_history")
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per epoch of the binary model: rate, losses and scores."""
    return linear_training.epoch_table(spark, _coarse_logistic(spark, sf_dir, BINARY_LABEL)[1]).drop("kept")


@query("m05_objective_history")
def objective_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training loss after each L-BFGS iteration of the fine model."""
    rows = [(i, a.solver, a.iterations, a.objective) for i, a in enumerate(_fine_attempts(spark, sf_dir)[1], 1)]
    model = _fine_logistic(spark, sf_dir)
    if not model.hasSummary:
        return spark.createDataFrame([(r[2], r[3]) for r in rows], "iteration int, loss double")
    return models.objective_history(spark, model)


# --- invariants of trained models, restated in SQL --------------------------------

_SIZES = """sizes AS (SELECT n, ceil(0.2 * n)::BIGINT AS held, ceil(0.5 * ceil(0.2 * n))::BIGINT AS test FROM (SELECT count(*) AS n FROM flows)),
split_sizes AS (SELECT 'train' AS split, n - held AS rows FROM sizes UNION ALL SELECT 'val', held - test FROM sizes UNION ALL SELECT 'test', test FROM sizes)"""
_LABELS = "labels(label) AS (VALUES ('Label_2'), ('Label_8'))"


def _judged(table: DataFrame, counts: DataFrame, label: str) -> DataFrame:
    """Rows of each split, whether its scores lie in their range, and whether the model beats naming the largest class."""
    counts = materialize(counts, "counts")  # read twice below: the model runs once a row
    scores = metrics.summary_metrics(counts, [SPLIT])
    largest = counts.groupBy(SPLIT, "truth").agg(F.sum("n").alias("n")).groupBy(SPLIT).agg(F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("share"))
    in_range = F.lit(True)
    for m in (*metrics.METRICS, "weighted_f1"):
        in_range = in_range & F.col(m).between(0, 1)
    return scores.join(largest, SPLIT).select(
        F.lit(label).alias("label"), SPLIT, "rows", in_range.alias("in_range"), (F.col("accuracy") > F.col("share")).alias("beats_largest_class"))


def _invariants(spark: SparkSession, sf_dir: str, model_of) -> DataFrame:
    table, out = coarse_table(spark, sf_dir), None
    for label, classes in ((BINARY_LABEL, BINARY_CLASSES), (FAMILY_LABEL, FAMILIES)):
        part = _judged(table.data, evaluate(model_of(label, classes), table, label, classes).counts, label)
        out = part if out is None else out.unionByName(part)
    return out


@query("m02_m03_minibatch_invariants", over_flows("SELECT label, split, rows, true AS in_range, true AS beats_largest_class FROM labels, split_sizes", _SIZES, _LABELS))
def minibatch_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _invariants(spark, sf_dir, lambda label, classes: _coarse_logistic(spark, sf_dir, label)[0])


@query("m04_early_stopping", """SELECT label, true AS one_row_per_epoch, true AS winner_agrees, true AS stop_agrees, true AS best_weights_restored
FROM (VALUES ('Label_2'), ('Label_8')) t(label)""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and stop derived in SQL from the history of each mini-batch model, against the trainer's own."""
    table, out = coarse_table(spark, sf_dir), None
    for label, classes in ((BINARY_LABEL, BINARY_CLASSES), (FAMILY_LABEL, FAMILIES)):
        model, trained = _coarse_logistic(spark, sf_dir, label)
        history = linear_training.epoch_table(spark, trained)
        delta, patience = linear_training.EARLY_STOP_DELTA, linear_training.EARLY_STOP_PATIENCE
        walked = history.groupBy().agg(F.array_sort(F.collect_list(F.struct("epoch", "val_f1"))).alias("h"), F.max("epoch").alias("last"), F.count(F.lit(1)).alias("n")).select(
            "last", "n", F.expr(f"""aggregate(h, named_struct('best', CAST(NULL AS DOUBLE), 'epoch', 0, 'stop', 0),
              (s, e) -> IF(s.best IS NULL OR e.val_f1 > s.best + {delta!r}D, named_struct('best', e.val_f1, 'epoch', e.epoch, 'stop', s.stop),
                named_struct('best', s.best, 'epoch', s.epoch, 'stop', IF(s.stop = 0 AND e.epoch - s.epoch >= {patience}, e.epoch, s.stop))))""").alias("s"))
        stop = F.when(F.col("s.stop") > 0, F.col("s.stop")).otherwise(linear_training.EPOCHS)
        counts = evaluate(model, table, label, classes).counts.where(F.col(SPLIT) == "val")
        f1, best = metrics.summary_metrics(counts).first()["f1"], trained.history[trained.best_epoch - 1].val_f1
        part = walked.select(
            F.lit(label).alias("label"), (F.col("n") == F.col("last")).alias("one_row_per_epoch"),
            (F.col("s.epoch") == trained.best_epoch).alias("winner_agrees"), (stop == F.col("last")).alias("stop_agrees"),
            F.lit(abs(f1 - best) < 1e-9).alias("best_weights_restored"))
        out = part if out is None else out.unionByName(part)
    return out


_RETRY = [1, 2]


@query("m01_solver_retry", """SELECT * FROM (VALUES (1, 'l-bfgs', 1, false, false), (2, 'l-bfgs', 2, false, false), (3, 'variance-reduced', 200, true, true))
t(attempt, solver, max_iter, converged, reaches_objective)""")
def solver_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-BFGS is stopped after one and two iterations: the second solver has to reach the objective of the model that converged."""
    model, attempts = train_fine_logistic(fine_table(spark, sf_dir), ROW_ID, iterations=_RETRY)
    least = _fine_attempts(spark, sf_dir)[1][-1].objective
    return models.attempts_table(spark, attempts).select(
        "attempt", "solver", "max_iter", "converged", (F.abs(F.col("objective") - least) < 1e-4).alias("reaches_objective"))


@query("m01_fine_invariants", "SELECT split, CAST(1 AS BIGINT) AS row_sets, true AS in_range, true AS beats_largest_class FROM (VALUES ('train'), ('val'), ('test')) t(split)")
def fine_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fine_table(spark, sf_dir)
    counts = evaluate(_fine_logistic(spark, sf_dir), table, LABEL, CLASSES_FINE).counts
    sizes = table.data.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("size"))
    return _judged(table.data, counts, LABEL).join(sizes, SPLIT).select(
        SPLIT, (F.col("rows") == F.col("size")).cast("long").alias("row_sets"), "in_range", "beats_largest_class")


@query("m06_fine_forest")
def fine_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_metrics(_fine_forest(spark, sf_dir), fine_table(spark, sf_dir), LABEL, CLASSES_FINE)


def _search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned rows of the searches of both labels."""
    return shared(spark, sf_dir, "search rows", lambda: coarse_search_rows(coarse_table(spark, sf_dir), ROW_ID, TUNE_SUBSET_ROWS))


def _forest_search(spark: SparkSession, sf_dir: str, label: str, classes: list[str]) -> tuple[dict, DataFrame]:
    return shared(spark, sf_dir, f"forest search {label}", lambda: models.tune_forest(_search_rows(spark, sf_dir), label, classes))


def _coarse_forest_model(spark: SparkSession, sf_dir: str, label: str, classes: list[str]) -> Model:
    """Tuned forest, fitted on all training rows."""

    def build() -> Model:
        t = coarse_table(spark, sf_dir)
        return _fitted_forest(t, label, classes, _forest_search(spark, sf_dir, label, classes)[0])

    return shared(spark, sf_dir, f"forest {label}", build)


def _coarse_forest(spark: SparkSession, sf_dir: str, label: str, classes: list[str]) -> DataFrame:
    return _split_metrics(_coarse_forest_model(spark, sf_dir, label, classes), coarse_table(spark, sf_dir), label, classes)


@query("m07_binary_forest")
def binary_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse_forest(spark, sf_dir, BINARY_LABEL, BINARY_CLASSES)


@query("m07_family_forest")
def family_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse_forest(spark, sf_dir, FAMILY_LABEL, FAMILIES)


@query("m07_forest_invariants", over_flows("SELECT label, split, rows, true AS in_range, true AS beats_largest_class FROM labels, split_sizes", _SIZES, _LABELS))
def forest_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _invariants(spark, sf_dir, lambda label, classes: _coarse_forest_model(spark, sf_dir, label, classes))


@query("m08_forest_search")
def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest_search(spark, sf_dir, FAMILY_LABEL, FAMILIES)[1]


def _drawn_sql() -> str:
    """The drawn settings as SQL values."""
    rows = [(i, s["numTrees"], s["maxDepth"], s["minSplit"], s["minInstancesPerNode"]) for i, s in enumerate(models.draw_settings(models.FOREST_GRID))]
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows)


@query("m08_search_invariants", over_flows(f"""
SELECT label, CAST(draw AS INTEGER) AS draw, CAST(trees AS INTEGER) AS trees, CAST(depth AS INTEGER) AS depth, CAST(min_split AS INTEGER) AS min_split,
  CAST(min_leaf AS INTEGER) AS min_leaf, CAST(3 AS BIGINT) AS folds, least({TUNE_SUBSET_ROWS}, n - held) AS scored_rows,
  true AS in_range, true AS beats_largest_class, true AS equals_twins
FROM labels, sizes, (VALUES {_drawn_sql()}) t(draw, trees, depth, min_split, min_leaf)""", _SIZES, _LABELS))
def search_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn setting scored all folds; settings that differ in the least split alone score alike."""
    out = None
    for label, classes in ((BINARY_LABEL, BINARY_CLASSES), (FAMILY_LABEL, FAMILIES)):
        found = _forest_search(spark, sf_dir, label, classes)[1]
        share = _search_rows(spark, sf_dir).groupBy(ident(label)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
        twins = Window.partitionBy("trees", F.coalesce("depth", F.lit(models.DEEPEST)), "min_leaf")
        # naming the largest class, of share s, has the weighted F1 s * 2s / (1 + s)
        part = found.select(
            F.lit(label).alias("label"), "draw", "trees", "depth", "min_split", "min_leaf", "folds", "scored_rows", F.col("weighted_f1").between(0, 1).alias("in_range"),
            (F.col("weighted_f1") > 2 * share * share / (1 + share)).alias("beats_largest_class"),
            (F.max("weighted_f1").over(twins) - F.min("weighted_f1").over(twins) < 1e-9).alias("equals_twins"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m09_fine_model_scoring")
def fine_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fine_table(spark, sf_dir)
    tidy = sanitize(_raw(spark, sf_dir), t.features, FINE_LABELS, [ROW_ID]).data
    scored = score_fine(tidy, t.prep, _fine_logistic(spark, sf_dir), CLASSES_FINE, [ROW_ID])
    return scored.select(ROW_ID, "predicted_class", "confidence", F.to_json("top_3_predictions").alias("top_3_predictions"))


@query("m10_coarse_model_scoring")
def coarse_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = coarse_table(spark, sf_dir, True)
    tidy = sanitize(_raw(spark, sf_dir), t.features, COARSE_LABELS, [ROW_ID]).data
    binary, _ = _coarse_logistic(spark, sf_dir, BINARY_LABEL)
    family, _ = _coarse_logistic(spark, sf_dir, FAMILY_LABEL)
    return score_coarse(tidy, t.prep, binary, family, BINARY_CLASSES, FAMILIES, [ROW_ID])


@query("m11_scored_splits")
def scored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fine_table(spark, sf_dir)
    rows = models.training_rows(t.data, t.features, LABEL, CLASSES_FINE, keep=[ROW_ID, SPLIT])
    return models.score_splits(_fine_logistic(spark, sf_dir), rows, CLASSES_FINE, [ROW_ID, SPLIT])


@query("s10_bundle_round_trip", over_flows("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differences FROM flows"))
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored by a saved and reloaded bundle, and how many of them the model in memory scores otherwise."""
    path = new_path(spark, "bundle")
    t = fine_table(spark, sf_dir)
    model = _fine_logistic(spark, sf_dir)
    tables.save_bundle(tables.Bundle(t.prep, {"fine": model}, {"fine": CLASSES_FINE}), path, spark)
    bundle = tables.load_bundle(spark, path)
    tidy = sanitize(_raw(spark, sf_dir), t.features, FINE_LABELS, [ROW_ID]).data
    columns = [ROW_ID, "predicted_class", "confidence"]
    here = score_fine(tidy, t.prep, model, CLASSES_FINE, [ROW_ID], rounded=False).select(*columns, F.lit(1).alias("n"))
    there = score_fine(tidy, bundle.prep, bundle.models["fine"], bundle.classes["fine"], [ROW_ID], rounded=False).select(*columns, F.lit(-1).alias("n"))
    both = here.unionByName(there).groupBy(*columns).agg(F.sum((F.col("n") < 0).cast("int")).alias("rows"), F.abs(F.sum("n")).alias("off"))
    return both.agg(F.sum("rows").alias("rows"), F.sum("off").alias("differences"))


@query("a30_forest_importance")
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.forest_importance(spark, _fine_forest(spark, sf_dir), fine_table(spark, sf_dir).features)


@query("a31_logistic_importance")
def logistic_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.logistic_importance(spark, _fine_logistic(spark, sf_dir), fine_table(spark, sf_dir).features)


@query("o08_top_features")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.top_features(forest_importance(spark, sf_dir))


_FINE_SIZES = f"""fine_plan AS (SELECT least(available, greatest({MIN_SAMPLES}, least({MAX_CAP},
  CAST(round_even(available * (CAST({TARGET_TOTAL} AS DOUBLE) / CAST(sum(available) OVER () AS DOUBLE)), 0) AS BIGINT)))) AS cap
  FROM (SELECT "Label", count(*) AS available FROM flows GROUP BY "Label")),
fine_sizes AS (SELECT n, CAST(ceil(0.2 * n) AS BIGINT) AS held, CAST(ceil(0.5 * ceil(0.2 * n)) AS BIGINT) AS test FROM (SELECT CAST(sum(cap) AS BIGINT) AS n FROM fine_plan))"""


@query("m11_scored_invariants", over_flows("""
SELECT 'train' AS split, n - held AS rows, n - held AS row_ids, true AS known_classes FROM fine_sizes UNION ALL SELECT 'val', held - test, held - test, true FROM fine_sizes
UNION ALL SELECT 'test', test, test, true FROM fine_sizes""", _FINE_SIZES))
def scored_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the sample is scored once, in its split, as one of the known classes."""
    known = F.col("predicted").isin(CLASSES_FINE) & F.col("truth").isin(CLASSES_FINE)
    return scored_splits(spark, sf_dir).groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(ROW_ID).alias("row_ids"), F.bool_and(known).alias("known_classes"))


_VARYING = "varying AS (SELECT feature FROM (" + stacked(FEATURES_FINE, "clean", {"low": "min({c})", "high": "max({c})"}) + ") WHERE low <> high)"


@query("a30_a31_importance_invariants", over_flows("""
SELECT model, feature, true AS valid, true AS complete FROM varying, (VALUES ('forest'), ('logistic')) t(model)""", clean_cte(), _VARYING))
def importance_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature that varies has an importance of its own: not negative, and in a forest adding up to 1."""
    out = None
    for name, table, whole in (("forest", forest_importance(spark, sf_dir), 1.0), ("logistic", logistic_importance(spark, sf_dir), None)):
        total = F.sum("importance").over(Window.partitionBy())  # a row per feature
        complete = total > 0 if whole is None else F.abs(total - whole) < 1e-9
        part = table.select(F.lit(name).alias("model"), "feature", (F.col("importance") >= 0).alias("valid"), complete.alias("complete"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o08_top_invariants", "SELECT CAST(range AS INTEGER) AS place, true AS in_order, true AS largest FROM range(1, 21)")
def top_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 features of most importance, largest first, none left out above the last."""
    every, top = forest_importance(spark, sf_dir), top_features(spark, sf_dir)
    ranked = every.select("feature", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")).alias("place"))
    listed = top.select("feature", F.col("importance").alias("kept"), F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")).alias("at"))
    before = F.lag("kept").over(Window.orderBy("at"))
    return listed.join(ranked, "feature").select(
        F.col("at").alias("place"), (before.isNull() | (before >= F.col("kept"))).alias("in_order"), (F.col("place") == F.col("at")).alias("largest"))


@query("s10_saved_bundle")
def saved_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the fine model with its transform, load both and score with them."""
    path = new_path(spark, "bundle")
    t = fine_table(spark, sf_dir)
    tables.save_bundle(tables.Bundle(t.prep, {"fine": _fine_logistic(spark, sf_dir)}, {"fine": CLASSES_FINE}), path, spark)
    bundle = tables.load_bundle(spark, path)
    tidy = sanitize(_raw(spark, sf_dir), bundle.prep.features, FINE_LABELS, [ROW_ID]).data
    scored = score_fine(tidy, bundle.prep, bundle.models["fine"], bundle.classes["fine"], [ROW_ID])
    return scored.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("rows"))


# --- streams ------------------------------------------------------------------------


@query("t01_stream_scoring", over_flows("""
SELECT b.flow_id, c.label AS predicted_class, round(b.p, 6) AS confidence FROM best b JOIN classes c ON c.idx = b.k WHERE b.place = 1""", *_FINE_P, _TOP))
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    prep = fine_preprocessing(spark, sf_dir)

    def scorer(df: DataFrame, keep: list[str]) -> DataFrame:
        return score_fine_linear(df, prep, weights, bias, CLASSES_FINE, keep, rounded=False)

    stream = record_stream(spark, json_folder(spark, sf_dir), FEATURES_FINE, [ROW_ID])
    output = new_path(spark, "stream")
    start_scoring(stream, scorer, [ROW_ID], output, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(output).select(ROW_ID, "predicted_class", F.round("confidence", 6).alias("confidence"))


def _lines_folder(spark: SparkSession, sf_dir: str) -> str:
    """All flows as JSON lines, with broken and foreign lines among them."""

    def build() -> str:
        good = F.to_json(F.struct(ROW_ID, *[F.col(ident(f)) for f in FEATURES_FINE]))
        broken = F.when(F.col("l_linenumber") == 1, F.concat(F.lit('{"Rate": '), ROW_ID))
        foreign = F.when(F.col("l_linenumber") == 2, F.to_json(F.struct(F.col(ROW_ID).alias("foo"))))
        folder = new_path(spark, "lines")
        # the flows are joined once for all kinds of lines
        lines = flows(spark, sf_dir).select(F.explode(F.array_compact(F.array(good, broken, foreign))).alias("value"))
        lines.write.options(**PACKED).text(folder)
        return folder

    return shared(spark, sf_dir, "mixed lines", build)


@query("t01_stream_rejects", over_flows("""
SELECT 'scored' AS outcome, count(*) AS rows FROM flows
UNION ALL SELECT 'not a JSON object', count(*) FROM flows WHERE l_linenumber = 1
UNION ALL SELECT 'no expected feature', count(*) FROM flows WHERE l_linenumber = 2"""))
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all flows with broken and foreign lines among them: only the records are scored."""
    folder, scored, rejects = _lines_folder(spark, sf_dir), new_path(spark, "stream"), new_path(spark, "rejects")
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    prep = fine_preprocessing(spark, sf_dir)

    def scorer(rows: DataFrame, keep: list[str]) -> DataFrame:
        return score_fine_linear(rows, prep, weights, bias, CLASSES_FINE, keep, rounded=False)

    stream = record_stream(spark, folder, FEATURES_FINE, [ROW_ID])
    start_scoring(stream, scorer, [ROW_ID], scored, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    start_rejects(stream, rejects, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    counts = spark.read.parquet(rejects).groupBy(F.col(REASON).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(spark.read.parquet(scored).agg(F.lit("scored").alias("outcome"), F.count(F.lit(1)).alias("rows")))


def _event_class():
    """Events as scored flows: viewing is benign, the other types are attacks."""
    return F.when(F.col("event_type") == "view", "BENIGN").otherwise(F.upper("event_type"))


def _event_folder(spark: SparkSession, sf_dir: str) -> str:
    def build() -> str:
        path = new_path(spark, "events")
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events.select(F.col("ts").cast("timestamp").alias("ts"), _event_class().alias("predicted_class")).write.parquet(path)
        return path

    return shared(spark, sf_dir, "event files", build)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema("ts timestamp, predicted_class string").parquet(_event_folder(spark, sf_dir))


_EVENT_CTE = "WITH scored AS (SELECT ts, CASE WHEN event_type = 'view' THEN 'BENIGN' ELSE upper(event_type) END AS predicted_class FROM events)"
_EVENT_COUNTS = """count(*) AS rows, count(*) FILTER (predicted_class <> 'BENIGN') AS attacks,
  count(DISTINCT CASE WHEN predicted_class <> 'BENIGN' THEN predicted_class END) AS attack_types,
  CAST(count(*) FILTER (predicted_class <> 'BENIGN') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS attack_share"""
_STATUS = """CASE WHEN attack_share > 0.8 THEN 'Critical' WHEN attack_share > 0.3 AND attack_types >= 5 THEN 'Critical'
  WHEN attack_share <= 0.3 THEN 'Stable' ELSE 'Warning' END AS status"""


@query("t02_batch_health", f"{_EVENT_CTE} SELECT *, {_STATUS} FROM (SELECT {_EVENT_COUNTS} FROM scored)")
def batch_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "health")
    stream_health.start_batch_health(
        _event_stream(spark, sf_dir), "predicted_class", output, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(output).select("rows", "attacks", "attack_types", "attack_share", "status")


_DRIFT_BATCHES = ["l_linenumber = 1", "l_linenumber = 2", "l_linenumber IN (3, 4)", "l_linenumber > 4"]
_BATCH_FILES = 4
#: Rows of an arriving file: more rows make more files a batch, not larger ones.
_ARRIVAL_ROWS = 250_000


def _files_of(rows: int) -> int:
    """Files of each of four batches of a table of ``rows`` rows."""
    return max(_BATCH_FILES, -(-rows // (4 * _ARRIVAL_ROWS)))


_SHIFTS = ", ".join(f"abs(avg({quoted(f)}) - any_value(m{i})) / any_value(s{i})" for i, f in enumerate(FEATURES_FINE))


def _drift_sql(scope: str, condition: str) -> str:
    return f"""SELECT batch_id, {text(scope)} AS scope, c.rows, attacks, attack_types, CAST(attacks AS DOUBLE) / CAST(c.rows AS DOUBLE) AS attack_share,
  round(class_shift, 9) AS class_shift, class_alerts, round(list_max(shifts), 6) AS feature_shift, CAST(len([x FOR x IN shifts IF x > 3]) AS BIGINT) AS feature_alerts
FROM (SELECT b.batch AS batch_id, count(*) AS rows, count(*) FILTER (predicted <> 'BENIGN') AS attacks,
    count(DISTINCT CASE WHEN predicted <> 'BENIGN' THEN predicted END) AS attack_types, [{_SHIFTS}] AS shifts
  FROM batches b JOIN dealt d ON {condition} JOIN clean USING (flow_id) JOIN scaler ON true GROUP BY b.batch) c
JOIN (SELECT batch, max(abs(coalesce(now, 0) - coalesce(share, 0))) AS class_shift,
    count(*) FILTER (now IS NULL OR share IS NULL OR abs(now - share) > 0.02) AS class_alerts
  FROM (SELECT b.batch, coalesce(n.class, t.class) AS class, n.now, t.share FROM batches b JOIN (
      SELECT b.batch, d.predicted AS class, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY b.batch) AS DOUBLE) AS now
      FROM batches b JOIN dealt d ON {condition} GROUP BY b.batch, d.predicted) n ON n.batch = b.batch FULL JOIN
      (SELECT batch, class, share FROM batches, trained) t ON t.batch = n.batch AND t.class = n.class) GROUP BY batch) s ON s.batch = c.batch_id"""


@query("t02_batch_drift", over_flows(
    "SELECT *, " + """CASE WHEN attack_share > 0.8 THEN 'Critical' WHEN attack_share > 0.3 AND attack_types >= 5 THEN 'Critical'
  WHEN attack_share <= 0.3 THEN 'Stable' ELSE 'Warning' END AS status FROM (""" + _drift_sql("batch", "d.batch = b.batch") + " UNION ALL " + _drift_sql("so far", "d.batch <= b.batch") + ")",
    clean_cte(), scaler_cte(FEATURES_FINE, "clean"),
    "dealt AS (SELECT flow_id, predicted, CAST(CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(_DRIFT_BATCHES)) + " END AS BIGINT) AS batch FROM flows)",
    "batches AS (SELECT DISTINCT batch FROM dealt)",
    """trained AS (SELECT "Label" AS class, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM flows WHERE split = 'train' GROUP BY "Label")"""))
def batch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows arrive in four batches of as many files as a trigger takes; status and drift of each and of all so far."""
    folder, output = new_path(spark, "arrivals"), new_path(spark, "drift")
    df = flows(spark, sf_dir)
    files = _files_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    columns = [F.col("predicted"), *[F.col(ident(f)) for f in FEATURES_FINE]]
    for condition in _DRIFT_BATCHES:  # files are taken in the order they were written
        df.where(condition).select(*columns).repartition(files, F.xxhash64(ROW_ID)).write.mode("append").parquet(folder)
    arrivals = spark.readStream.schema(df.select(*columns).schema).option("maxFilesPerTrigger", files).parquet(folder)
    trained = class_shares(df.where(F.col(SPLIT) == "train"), LABEL).select(F.col(LABEL).alias("class"), "share")
    shares = materialize(trained, "shares")
    start_drift(
        arrivals, "predicted", FEATURES_FINE, shares, fine_preprocessing(spark, sf_dir).scaler, output, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    found = spark.read.parquet(f"{output}/drift").drop("batch")
    return found.withColumn("class_shift", F.round("class_shift", 9)).withColumn("feature_shift", F.round("feature_shift", 6))


#: Events in three thirds of their time; every fifth one arrives with the third after its own.
_EVENT_BATCH_SQL = """CAST(least(2, floor(3 * (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) + 1))
  + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT)"""


@query("t03_closed_windows", f"""WITH e AS (SELECT ts, CASE WHEN event_type = 'view' THEN 'BENIGN' ELSE upper(event_type) END AS predicted_class, {_EVENT_BATCH_SQL} AS batch FROM events),
b AS (SELECT batch, count(*) AS n, max(ts) AS top FROM e GROUP BY batch),
w AS (SELECT batch, n, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark, max(top) OVER () - INTERVAL 10 MINUTE AS final FROM b),
j AS (SELECT e.*, w.final, time_bucket(INTERVAL 1 HOUR, e.ts) AS start, coalesce(time_bucket(INTERVAL 1 HOUR, e.ts) + INTERVAL 1 HOUR <= w.mark, false) AS late FROM e JOIN w USING (batch)),
closed AS (SELECT CAST(epoch(start) AS BIGINT) AS window_start, count(*) AS rows, count(*) FILTER (predicted_class <> 'BENIGN') AS attacks,
  count(DISTINCT CASE WHEN predicted_class <> 'BENIGN' THEN predicted_class END) AS attack_types FROM j WHERE NOT late AND start + INTERVAL 1 HOUR <= final GROUP BY start)
SELECT 'window' AS kind, window_start AS place, rows, attacks, attack_types FROM closed
UNION ALL SELECT 'late', batch, count(*) FILTER (late), count(*) FILTER (late AND predicted_class <> 'BENIGN'),
  count(DISTINCT CASE WHEN late AND predicted_class <> 'BENIGN' THEN predicted_class END) FROM j GROUP BY batch""")
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that closed, each once, and the late rows of each batch."""
    folder, output = new_path(spark, "arrivals"), new_path(spark, "closing")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    part = F.floor(F.lit(3) * (micros - low) / F.lit(high - low + 1)) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    dealt = events.select(F.col("ts").cast("timestamp").alias("ts"), _event_class().alias("predicted_class"), F.least(F.lit(2), part).alias("third"), "event_id")
    for third in range(3):
        dealt.where(F.col("third") == third).repartition(_BATCH_FILES, "event_id").select("ts", "predicted_class").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ts timestamp, predicted_class string").option("maxFilesPerTrigger", _BATCH_FILES).parquet(folder)
    start_closing_windows(stream, "predicted_class", output, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    windows = spark.read.parquet(f"{output}/windows").select(
        F.lit("window").alias("kind"), F.col("window_start").cast("long").alias("place"), "rows", "attacks", "attack_types")
    late = spark.read.schema("ts timestamp, predicted_class string, batch long").parquet(f"{output}/late")
    attack = F.col("predicted_class") != "BENIGN"
    counted = late.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if(attack).alias("attacks"), F.count_distinct(F.when(attack, F.col("predicted_class"))).alias("attack_types"))
    every = spark.read.parquet(f"{output}/batches").select(F.col("batch_id").alias("batch")).join(counted, "batch", "left").fillna(0)
    return windows.unionByName(every.select(F.lit("late").alias("kind"), F.col("batch").alias("place"), "rows", "attacks", "attack_types"))


@query("s04_scored_lines", over_flows("""
SELECT 'scored' AS outcome, label AS what, count(*) AS rows FROM best JOIN classes ON idx = k WHERE place = 1 GROUP BY label
UNION ALL SELECT 'rejected', 'not a JSON object', count(*) FROM flows WHERE l_linenumber = 1
UNION ALL SELECT 'rejected', 'no expected feature', count(*) FROM flows WHERE l_linenumber = 2
UNION ALL SELECT 'adjusted', 'rows', count(*) FROM flows WHERE "AVG" IS NULL OR isinf("Rate")
UNION ALL SELECT 'adjusted', 'values', CAST(sum(CAST("AVG" IS NULL AS INT) + CAST(isinf("Rate") AS INT)) AS BIGINT) FROM flows
UNION ALL SELECT 'index', 'lines', (SELECT count(*) FROM flows) + count(*) FROM flows WHERE l_linenumber <= 2
UNION ALL SELECT 'index', 'last', (SELECT count(*) FROM flows) + count(*) - 1 FROM flows WHERE l_linenumber <= 2""", *_FINE_P, _TOP))
def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with broken and foreign ones among them, scored end to end."""
    weights, bias = fixed_weights(len(FEATURES_FINE), len(CLASSES_FINE))
    bundle = tables.Bundle(fine_preprocessing(spark, sf_dir), {"fine": linear_model(spark, weights, bias)}, {"fine": CLASSES_FINE})
    run = score_json(spark, _lines_folder(spark, sf_dir), bundle, "fixed")
    rows = run.predictions.groupBy(F.lit("scored").alias("outcome"), F.col("predicted_class").alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    bad = run.rejects.groupBy(F.lit("rejected").alias("outcome"), F.col(REASON).alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    note = run.adjustments.select(F.inline(F.array(*[
        F.struct(F.lit("adjusted").alias("outcome"), F.lit(n).alias("what"), F.col(c).alias("rows")) for n, c in (("rows", "rows_adjusted"), ("values", "invalid_values_replaced"))])))
    index = run.predictions.select("index").unionByName(run.rejects.select("index"))
    ends = index.agg(F.count_distinct("index").alias("n"), F.max("index").alias("last")).select(F.inline(F.array(
        F.struct(F.lit("index").alias("outcome"), F.lit("lines").alias("what"), F.col("n").alias("rows")), F.struct(F.lit("index").alias("outcome"), F.lit("last").alias("what"), F.col("last").alias("rows")))))
    return rows.unionByName(bad).unionByName(note).unionByName(ends)


@query("t03_windowed_health", f"""{_EVENT_CTE} SELECT *, {_STATUS} FROM (
SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, {_EVENT_COUNTS} FROM scored GROUP BY 1)""")
def windowed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "windows")
    windows = stream_health.windowed_health(_event_stream(spark, sf_dir), "predicted_class")
    stream_health.start_windowed_health(windows, output, new_path(spark, "checkpoint"), "complete", available_now=True).awaitTermination()
    return spark.read.parquet(output).select(
        F.col("window_start").cast("long").alias("window_start"), "rows", "attacks", "attack_types", "attack_share", "status")
