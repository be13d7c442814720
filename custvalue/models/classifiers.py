"""The classifiers that are compared, each as a recipe: (train rows, row count) -> model.

Rows have ``label`` (0/1) and ``features`` (a vector). A model's ``transform`` adds ``prediction``. Penalties are stated per row in Spark and per data set in
the formulas ``C`` comes from, hence ``1 / (C * rows)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.models.boost_many import Boost, BoostedStumps, fit_boost
from custvalue.models.logistic_many import model_rows
from custvalue.models.margin_many import MarginFit, fit_margins
from custvalue.models.trees_many import (
    ASKED,
    Forest,
    Rule,
    importances,
    tree_rows,
    votes,
)

@dataclass(frozen=True)
class Recipe:
    """A classifier with its settings, ready to be fitted."""

    kind: str
    settings: dict[str, Any] = field(hash=False)
    fit: Callable[[DataFrame, int], Any] = field(hash=False, repr=False)
    # Trees that can be grown together with those of other recipes.
    forest: Forest | None = field(default=None, hash=False, repr=False)
    # Stumps that can be boosted together with those of other recipes.
    boost: Boost | None = field(default=None, hash=False, repr=False)
    # Of a fit with hinge loss: the weight of a row beside half the squared weights, by the number
    # of rows learned from.
    strength: Callable[[int], float] | None = field(default=None, hash=False, repr=False)

    @property
    def identity(self) -> tuple[str, str]:
        """Recipes of the same identity give the same model."""
        return self.kind, str(sorted(self.settings.items()))

    def __str__(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.settings.items())


def logistic(c: float, l1: bool = False) -> Recipe:
    """Logistic regression with a penalty on every weight but the intercept."""

    def fit(train: DataFrame, rows: int):
        return LogisticRegression(
            regParam=1.0 / (c * rows),
            elasticNetParam=1.0 if l1 else 0.0,
            standardization=False,
            family="binomial",
        ).fit(train)

    return Recipe("logistic", {"C": c, "penalty": "l1" if l1 else "l2"}, fit)


@dataclass
class MarginModel:
    """A fitted linear classifier with hinge loss: a positive margin predicts label 1."""

    coefficients: Sequence[float]
    intercept: float
    gap: float

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        terms = F.zip_with(x, weights, lambda a, b: a * b)
        margin = F.aggregate(terms, F.lit(float(self.intercept)), lambda a, b: a + b)
        return df.withColumn("prediction", F.when(margin > 0, 1.0).otherwise(0.0))


def _margin_model(c: float) -> Callable[[DataFrame], MarginModel]:
    def fit(train: DataFrame) -> MarginModel:
        rows = model_rows(train.drop("fold")).cache()
        try:
            weights, gaps = fit_margins(rows, [MarginFit(c)])
        finally:
            rows.unpersist()
        return MarginModel(weights[0, :-1].tolist(), float(weights[0, -1]), float(gaps[0]))

    return fit


def linear_svm(c: float) -> Recipe:
    """Hinge loss of weight ``c`` per row beside half the squared weights."""
    return Recipe(
        "linear_svm", {"C": c}, lambda train, rows: _margin_model(c)(train), strength=lambda rows: c
    )


def hinge_linear(alpha: float) -> Recipe:
    """Hinge loss with a squared penalty of weight ``alpha`` per row."""

    def strength(rows: int) -> float:
        return 1.0 / (alpha * rows)

    def fit(train: DataFrame, rows: int) -> MarginModel:
        return _margin_model(strength(rows))(train)

    return Recipe("hinge_linear", {"alpha": alpha}, fit, strength=strength)


class GrownTrees:
    """Trees that grow when they are asked: rows to judge meet the training rows in the tasks that
    grow the trees, so no full-grown tree leaves them.

    Rows need a ``key`` without repeats or nulls, in training and in what is judged.
    """

    def __init__(self, train: DataFrame, forest: Forest, rows: int):
        self.train, self.forest, self.rows = tree_rows(train.drop("fold")), forest, rows

    def transform(self, df: DataFrame) -> DataFrame:
        asked = tree_rows(df).withColumn("fold", F.lit(ASKED))
        trees = self.forest.trees(ASKED, self.rows)
        found = votes(self.train.unionByName(asked), trees).groupBy("key").agg(
            F.sum(F.round(F.col("p")[0], 12)).alias("__sum")
        )
        above = F.round(2 * F.col("__sum") - len(trees), 9) > 0
        guessed = found.select("key", above.cast("double").alias("prediction"))
        return df.join(guessed, "key", "left").select(*df.columns, "prediction")

    def importances(self) -> list[float]:
        return importances(self.train, self.forest.trees(None, self.rows)).tolist()


def _forest(kind: str, settings: dict[str, Any], forest: Forest) -> Recipe:
    def fit(train: DataFrame, rows: int) -> GrownTrees:
        return GrownTrees(train, forest, rows)

    return Recipe(kind, settings, fit, forest)


def decision_tree(criterion: str, depth: int, split_share: float, feature_share: float) -> Recipe:
    """A single tree that looks at a share of the features at each split and splits no node with
    less than a share of the rows."""
    settings = {
        "criterion": criterion,
        "max_depth": depth,
        "min_samples_split": split_share,
        "max_features": feature_share,
    }
    rule = Rule(criterion, split_share, node_share=feature_share)
    return _forest("decision_tree", settings, Forest(rule, 1, depth))


def random_forest(split_share: float, depth: int, trees: int = 10) -> Recipe:
    """Trees on row samples, each split looking at as many features as the root of their number."""
    settings = {"min_samples_split": split_share, "max_depth": depth}
    rule = Rule("gini", split_share, node_share=None, sample=1.0)
    return _forest("random_forest", settings, Forest(rule, trees, depth))


def bagging(trees: int, sample_share: float, feature_share: float) -> Recipe:
    """Full-grown trees on row samples and feature subsets; their probabilities are averaged."""
    settings = {"n_estimators": trees, "max_samples": sample_share, "max_features": feature_share}
    rule = Rule(tree_share=feature_share, sample=sample_share)
    return _forest("bagging", settings, Forest(rule, trees))


def ada_boost(rounds: int, rate: float) -> Recipe:
    """Boosted stumps on class probabilities (the real-valued variant for two classes)."""
    boost = Boost(rounds, rate)

    def fit(train: DataFrame, rows: int) -> BoostedStumps:
        learned = model_rows(train.drop("fold")).cache()
        try:
            return fit_boost(learned, boost)
        finally:
            learned.unpersist()

    settings = {"n_estimators": rounds, "learning_rate": rate}
    return Recipe("ada_boost", settings, fit, boost=boost)
