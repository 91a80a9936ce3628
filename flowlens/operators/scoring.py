"""Scoring: one narrow, shuffle-free plan from raw flows to predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import decode
from ..functions.numeric import round_probability
from ..functions.probabilities import confidence, top_classes
from ..schema import ident
from .transforms import skew_log, standardized


@dataclass
class Preprocessing:
    """Fitted input transform: optional log minimums, then scaler values."""

    features: list[str]
    scaler: dict[str, tuple[float, float]]
    log_minimums: dict[str, float] = field(default_factory=dict)

    def input(self, feature: str) -> Column:
        """Model input of a feature; a null becomes 0, the training mean.

        Filling after the logarithm and the scaling means the fallback is the
        mean in the space the model was trained in.
        """
        c = F.col(ident(feature))
        if feature in self.log_minimums:
            c = skew_log(c, self.log_minimums[feature])
        return F.coalesce(standardized(c, *self.scaler[feature]), F.lit(0.0))

    def inputs(self) -> list[Column]:
        return [self.input(f) for f in self.features]


def feature_vector(inputs: list[Column]) -> Column:
    return array_to_vector(F.array(*inputs))


def fine_prediction(df: DataFrame, proba: str, predicted_index: Column, classes: list[str], keep: list[str], rounded: bool = True) -> DataFrame:
    """Predicted class, its confidence and the three most probable classes."""
    p = F.col(proba)
    named = df.withColumn("predicted_class", decode(predicted_index, classes))
    conf = confidence(p, F.col("predicted_class"), classes)
    top = top_classes(p, classes)
    if rounded:
        conf = round_probability(conf)
        top = F.transform(top, lambda x: F.struct(x["class"].alias("class"), F.round(x["probability"], 4).alias("probability")))
    return named.select(*[F.col(ident(k)) for k in keep], "predicted_class", conf.alias("confidence"), top.alias("top_3_predictions"))


def coarse_prediction(
    df: DataFrame, binary: tuple[str, Column, list[str]], family: tuple[str, Column, list[str]],
    keep: list[str], rounded: bool = True,
) -> DataFrame:
    """Binary label, family and the confidence of both, from two models on each row.

    Each model is given as (probability column, predicted index, classes).
    """
    named = df.withColumns({
        "binary_prediction": decode(binary[1], binary[2]), "attack_family": decode(family[1], family[2]),
    })
    conf_b = confidence(F.col(binary[0]), F.col("binary_prediction"), binary[2])
    conf_f = confidence(F.col(family[0]), F.col("attack_family"), family[2])
    if rounded:
        conf_b, conf_f = round_probability(conf_b), round_probability(conf_f)
    return named.select(
        *[F.col(ident(k)) for k in keep], "binary_prediction", "attack_family",
        conf_b.alias("confidence_binary"), conf_f.alias("confidence_attack"),
    )


def apply_model(df: DataFrame, model: Model, vector: str, name: str) -> DataFrame:
    """Run a Spark ML classifier with output columns of its own."""
    scorer = model.copy()
    scorer.setFeaturesCol(vector)
    scorer.setPredictionCol(f"{name}_index")
    scorer.setProbabilityCol(f"{name}_vector")
    scorer.setRawPredictionCol("")
    out = scorer.transform(df)
    return out.withColumn(f"{name}_proba", vector_to_array(F.col(f"{name}_vector"))).drop(f"{name}_vector")


def score_fine(df: DataFrame, prep: Preprocessing, model: Model, classes: list[str], keep: list[str], rounded: bool = True) -> DataFrame:
    """Sanitized flows to fine predictions with a fitted model."""
    vectors = df.withColumn("__x", feature_vector(prep.inputs()))
    scored = apply_model(vectors, model, "__x", "fine")
    return fine_prediction(scored, "fine_proba", F.col("fine_index"), classes, keep, rounded)


def score_coarse(
    df: DataFrame, prep: Preprocessing, binary_model: Model, family_model: Model,
    binary_classes: list[str], family_classes: list[str], keep: list[str], rounded: bool = True,
) -> DataFrame:
    """Sanitized flows to a binary label and a family; both models see every row."""
    vectors = df.withColumn("__x", feature_vector(prep.inputs()))
    scored = apply_model(vectors, binary_model, "__x", "binary")
    scored = apply_model(scored, family_model, "__x", "family")
    return coarse_prediction(
        scored, ("binary_proba", F.col("binary_index"), binary_classes),
        ("family_proba", F.col("family_index"), family_classes), keep, rounded,
    )


def linear_model(spark: SparkSession, weights: list[list[float]], bias: list[float]) -> LogisticRegressionModel:
    """A Spark ML classifier with the given weights (a row per class): scored, copied and saved like a fitted one."""
    sc = spark.sparkContext
    matrix = DenseMatrix(len(weights), len(weights[0]), [w for row in weights for w in row], isTransposed=True)
    uid = sc._jvm.org.apache.spark.ml.util.Identifiable.randomUID("logreg")
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        uid, _py2java(sc, matrix), _py2java(sc, Vectors.dense(bias)), len(weights), True)
    return LogisticRegressionModel(made)


def score_fine_linear(
    df: DataFrame, prep: Preprocessing, weights: list[list[float]], bias: list[float], classes: list[str],
    keep: list[str], rounded: bool = True,
) -> DataFrame:
    """Fine predictions from a plain weight matrix."""
    return score_fine(df, prep, linear_model(df.sparkSession, weights, bias), classes, keep, rounded)


def score_coarse_linear(
    df: DataFrame, prep: Preprocessing,
    binary: tuple[list[list[float]], list[float], list[str]], family: tuple[list[list[float]], list[float], list[str]],
    keep: list[str], rounded: bool = True,
) -> DataFrame:
    models = [linear_model(df.sparkSession, *m[:2]) for m in (binary, family)]
    return score_coarse(df, prep, *models, binary[2], family[2], keep, rounded)
