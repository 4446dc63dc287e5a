"""Classifiers, comparison and scoring. Search and cross-validation are in `selection`."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.operators.metrics import comparison
from finchlab.plans.adaboost import AdaBoost
from finchlab.plans.boosting import BoostedTrees
from finchlab.plans.features import PostFeatures
from finchlab.plans.forests import SEED, HistogramForest, Setting
from finchlab.plans.trees import MAX_DEPTH
from finchlab.plans.vectors import FittedVectors
from finchlab.sources.readers import single_post


def logistic_regression(rows: int, strength: float = 1.0) -> LogisticRegression:
    """L2 regression; `strength` is the inverse regularisation over a sum of losses."""
    return LogisticRegression(
        labelCol="target",
        elasticNetParam=0.0,
        regParam=1.0 / (strength * rows),
        standardization=False,
    )


def decision_tree(depth: int | None = None) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        labelCol="target", maxDepth=MAX_DEPTH if depth is None else depth, seed=SEED
    )


def random_forest(
    trees: int = 100, impurity: str = "gini", depth: int | None = None, leaf: int = 1
) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="target",
        numTrees=trees,
        impurity=impurity,
        maxDepth=MAX_DEPTH if depth is None else depth,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt",
        seed=SEED,
    )


def histogram_forest(setting: Setting, key: str = "post_id") -> HistogramForest:
    """A forest or tree with all of its settings, grown from histograms."""
    return HistogramForest.of(setting, key)


def boosted_trees(rounds: int = 100, depth: int = 3, step: float = 0.1, key: str = "post_id") -> BoostedTrees:
    return BoostedTrees(keyCol=key, rounds=rounds, depth=depth, step=step)


def default_estimators(rows: int) -> dict[str, Estimator]:
    """The models of the bake-off, in order."""
    return {
        "logistic regression": logistic_regression(rows),
        "decision tree": decision_tree(5),
        "random forest": random_forest(),
        "adaboost": AdaBoost(),
        "gradient boosting": boosted_trees(),
    }


def with_probability(predictions: DataFrame) -> DataFrame:
    """Class and positive-class probability as plain columns."""
    return predictions.withColumn(
        "y_pred_proba", vector_to_array(F.col("probability"))[1]
    ).withColumn("prediction", F.col("prediction").cast("int"))


def bake_off(
    train: DataFrame,
    test: DataFrame,
    estimators: dict[str, Estimator],
    predictions: dict[str, DataFrame] | None = None,
) -> tuple[dict[str, Transformer], DataFrame]:
    """Fit every estimator on `train`; compare F1 and recall on `test`.

    `predictions` adds test predictions made elsewhere, such as neighbour votes.
    """
    fitted = {name: estimator.fit(train) for name, estimator in estimators.items()}
    scored = {name: model.transform(test) for name, model in fitted.items()}
    scored |= predictions or {}
    return fitted, comparison(scored, "target", "prediction")


def _named_values(train: DataFrame, names: list[str], values, column: str) -> DataFrame:
    rows = [(i, name, float(v)) for i, (name, v) in enumerate(zip(names, values))]
    return train.sparkSession.createDataFrame(rows, f"idx int, feature string, {column} double")


def importances(model, names: list[str], frame: DataFrame, top: int | None = None) -> DataFrame:
    """(idx, feature, importance), largest first; one row per model feature."""
    table = _named_values(frame, names, model.featureImportances.toArray(), "importance")
    table = table.orderBy(F.col("importance").desc(), "idx")
    return table.limit(top) if top else table


def coefficients(model, names: list[str], frame: DataFrame) -> DataFrame:
    """(idx, feature, coefficient), smallest first."""
    table = _named_values(frame, names, model.coefficients.toArray(), "coefficient")
    return table.orderBy("coefficient", "idx")


def scoring_model(
    vectors: FittedVectors, classifier: Transformer, keep: list[str] = (), **features
) -> PipelineModel:
    """Raw posts to predictions as one persistable pipeline; nothing is refitted."""
    stages = [PostFeatures(keep=list(keep), **features), *vectors.stages, classifier]
    return PipelineModel(stages=stages)


def score(model: PipelineModel, posts: DataFrame) -> DataFrame:
    """Predictions for a batch or a stream of posts."""
    return with_probability(model.transform(posts))


def score_text(model: PipelineModel, spark: SparkSession, text: str) -> tuple[int, float]:
    """(class, positive-class probability) of one post."""
    row = score(model, single_post(spark, text)).select("prediction", "y_pred_proba").first()
    return row["prediction"], row["y_pred_proba"]
