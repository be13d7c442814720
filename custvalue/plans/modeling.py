"""From the customer table to a licence-purchase model and its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from custvalue.functions.nulls import named
from custvalue.models.classifiers import logistic
from custvalue.models.metrics import weighted_metrics
from custvalue.models.search import (
    FINAL_C,
    coefficient_report,
    drop_one_impact,
    most_missed,
    select_features,
    weights_of,
)
from custvalue.operators.columns import with_label, without_useless_names
from custvalue.operators.features import as_vectors, dummies, predict_missing, without_null_columns
from custvalue.operators.profile import split_kinds
from custvalue.operators.splits import stratified_split, with_folds
from custvalue.session import cut_lineage


@dataclass
class FeatureSet:
    """Train and test rows (key, label, feature columns) and the feature names in order."""

    train: DataFrame
    test: DataFrame
    features: list[str]

    def vectors(self, features: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(train, test) with key, label and a ``features`` vector."""
        chosen = self.features if features is None else list(features)
        return tuple(
            as_vectors(part, chosen, keep=["key", "label"]) for part in (self.train, self.test)
        )


def prepare_features(
    customers: DataFrame,
    key: str,
    target: str,
    drop: Sequence[str] = (),
    max_values: int = 1000,
    seed: int = 42,
) -> FeatureSet:
    """Indicator columns, useless columns out, stratified split, unknown numbers filled.

    ``drop`` names columns of the table or of its indicators. List cells are no features:
    their indicator columns are.
    The table is written to the checkpoint folder once it has its final columns, since the
    split and every small regression read it again.
    """
    lists = [f.name for f in customers.schema if isinstance(f.dataType, T.ArrayType)]
    plain = customers.drop(*lists, *[c for c in drop if c not in (key, target)])
    labelled = with_label(plain.withColumnRenamed(key, "key"), target)
    inputs = labelled.drop("key", "label")
    _, categorical = split_kinds(inputs)
    wide = without_useless_names(dummies(labelled, categorical, max_values)).drop(*drop)
    wide = cut_lineage(wide)
    features = [c for c in wide.columns if c not in ("key", "label")]
    train, test = stratified_split(wide, "label", "key", seed=seed)
    numeric, _ = split_kinds(wide.select(*map(named, features)))
    train, test = predict_missing(train, test, numeric, features)
    train, test, features = without_null_columns(train, test, features)
    return FeatureSet(cut_lineage(train), cut_lineage(test), features)


@dataclass
class LicenseModel:
    """What the final fit leaves behind."""

    features: list[str]
    metrics: DataFrame
    coefficients: DataFrame
    predictions: DataFrame


def fit_license_model(
    prepared: FeatureSet, c: float = FINAL_C, folds: int = 5
) -> LicenseModel:
    """Selection by absolute-value penalty, then by drop-one impact, then the final fit.

    Keeps all selected features if leaving out any one of them never hurts.
    """
    train, _ = prepared.vectors()
    selected = select_features(train, prepared.features)
    train, _ = prepared.vectors(selected)
    data = with_folds(train, "label", "key", folds)
    impacts = drop_one_impact(data, selected, c)
    best = [row.feature for row in most_missed(impacts).collect()] or selected
    train, test = prepared.vectors(best)
    model = logistic(c).fit(train, train.count())
    predictions = model.transform(test).select("key", "label", "prediction")
    return LicenseModel(
        best,
        weighted_metrics(predictions),
        coefficient_report(train.sparkSession, best, weights_of(model)),
        predictions,
    )
