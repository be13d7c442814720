"""Cross-validation, grid search, feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.models.classifiers import (
    MarginModel,
    Recipe,
    ada_boost,
    bagging,
    decision_tree,
    hinge_linear,
    linear_svm,
    logistic,
    random_forest,
)
from custvalue.models.boost_many import boost_scores
from custvalue.models.logistic_many import Fit, cross_validated, fold_scores, model_rows
from custvalue.models.margin_many import MarginFit, fit_margins
from custvalue.models.metrics import weighted_metrics
from custvalue.models.trees_many import forest_counts, tree_rows
from custvalue.operators.neighbors import nearest

FOLDS = 5

# The strengths of selection and final model, how many features stay, and the
# strengths and neighbour counts that are searched.
SELECTION_C = 5.0
FINAL_C = 17.0
KEPT_FEATURES = 20
LOGISTIC_GRID = tuple(float(c) for c in range(5, 25, 2))
NEIGHBOR_GRID = tuple(range(2, 20, 2))


def grid(kind: str) -> list[Recipe]:
    """The settings searched for each kind of classifier."""
    # The ranges of the search.
    if kind == "logistic":
        return [logistic(c) for c in LOGISTIC_GRID]
    if kind == "decision_tree":
        return [
            decision_tree(criterion, depth, 0.1, share)
            for criterion in ("gini", "entropy")
            for depth in range(15, 100, 2)
            for share in (0.5, 0.6, 0.7, 0.8)
        ]
    if kind == "linear_svm":
        return [linear_svm(float(c)) for c in range(5, 25, 2)]
    if kind == "hinge_linear":
        return [hinge_linear(round(0.00001 + 0.0001 * i, 5)) for i in range(10)]
    if kind == "random_forest":
        return [random_forest(s, d) for s in (0.25, 0.5, 1.0) for d in (5, 10, 20)]
    if kind == "bagging":
        return [bagging(n, s, f) for n in (5, 10, 15) for s in (0.5, 1.0) for f in (0.5, 1.0)]
    if kind == "ada_boost":
        return [ada_boost(n, r) for n in (5, 10, 15) for r in (0.001, 0.01, 0.1)]
    raise ValueError(f"unknown kind of classifier: {kind}")


def fold_sizes(data: DataFrame) -> dict[int, int]:
    rows = data.groupBy("fold").agg(F.count("*").alias("n")).collect()
    return {row.fold: row.n for row in rows}


def f1_of(predictions: DataFrame) -> float:
    return weighted_metrics(predictions).first().f1


def _ranked(
    spark, kinds: Sequence[str], settings: Sequence[str], scores: Sequence[float], rows: int
):
    """Settings by falling score, with the rows that were scored for each over all folds."""
    # Sums of parts come in any order: the last digits decide no place.
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 12), i))
    found = [(place, kinds[i], settings[i], scores[i], rows) for place, i in enumerate(order, 1)]
    return spark.createDataFrame(
        found, "place int, classifier string, settings string, mean_f1 double, rows bigint"
    )


def search(data: DataFrame, recipes: Sequence[Recipe], parallelism: int = 3) -> DataFrame:
    """Mean weighted F1 per recipe over the ``fold`` column; place 1 is best.

    Trees of all settings and folds grow together (their rows need a unique ``key``), and so do
    boosted stumps and hinge fits. Other fits run side by side, and settings that come to the same
    model are fitted once. ``data`` is cached: every fit reads all of it.
    """
    distinct = {r.identity: r for r in recipes}
    forests = {i: r.forest for i, r in distinct.items() if r.forest}
    boosts = {i: r.boost for i, r in distinct.items() if r.boost}
    margins = {i: r for i, r in distinct.items() if r.strength}
    single = {i: r for i, r in distinct.items() if not (r.forest or r.boost or r.strength)}
    data = data.cache()
    try:
        sizes = fold_sizes(data)
        total = sum(sizes.values())
        sums = dict.fromkeys(distinct, 0.0)
        if forests:
            sums.update(_forest_scores(data, forests, sizes))
        if boosts or margins:
            rows = model_rows(data).cache()
            try:
                if boosts:
                    found = boost_scores(rows, list(boosts.values()), sorted(sizes))
                    sums.update({i: sum(found[b]) for i, b in boosts.items()})
                if margins:
                    sums.update(_margin_scores(rows, margins, sizes))
            finally:
                rows.unpersist()

        def score(item):
            identity, fold = item
            train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
            return f1_of(single[identity].fit(train, total - sizes[fold]).transform(test))

        work = [(identity, fold) for identity in single for fold in sorted(sizes)]
        with ThreadPool(max(1, min(parallelism, len(work)))) as pool:
            scores = pool.map(inheritable_thread_target(data.sparkSession)(score), work)
    finally:
        data.unpersist()
    for (identity, _), f1 in zip(work, scores):
        sums[identity] += f1
    means = [sums[recipe.identity] / len(sizes) for recipe in recipes]
    return _ranked(
        data.sparkSession, [r.kind for r in recipes], list(map(str, recipes)), means, total
    )


def _margin_scores(rows: DataFrame, margins: dict, sizes: dict[int, int]) -> dict:
    """Per identity the weighted F1 of its hinge fits, added up over the folds."""
    total, folds = sum(sizes.values()), sorted(sizes)
    fits = [
        MarginFit(recipe.strength(total - sizes[fold]), fold)
        for recipe in margins.values()
        for fold in folds
    ]
    weights, _ = fit_margins(rows, fits)
    scores = fold_scores(rows, [Fit((), f.c, f.left_out) for f in fits], weights)
    n = len(folds)
    return {i: sum(scores[k * n : (k + 1) * n]) for k, i in enumerate(margins)}


def _forest_scores(data: DataFrame, forests: dict, sizes: dict[int, int]) -> dict:
    """Per identity the weighted F1 of its forest, added up over the folds."""
    counts = forest_counts(tree_rows(data), list(forests.values()), sizes)
    scores = weighted_metrics(counts, by=["forest", "fold"], count="n")
    found = {r.forest: r.f1 for r in scores.groupBy("forest").agg(F.sum("f1").alias("f1")).collect()}
    return {identity: found[i] for i, identity in enumerate(forests)}


def refitted(data: DataFrame, ranking: DataFrame, recipes: Sequence[Recipe]):
    """The recipe at place 1 fitted on all rows, with its model. ``data`` is read again by every
    step of the fit; the caller should hold it."""
    best = ranking.where("place = 1").first()
    recipe = next(r for r in recipes if (r.kind, str(r)) == (best.classifier, best.settings))
    return recipe, recipe.fit(data, best.rows)


def search_logistic(data: DataFrame, strengths: Sequence[float] = LOGISTIC_GRID) -> DataFrame:
    """Mean weighted F1 per strength of the logistic regression, all fitted together."""
    width = data.select("features").first().features.size
    scores = cross_validated(data, [(range(width), c) for c in strengths])
    names = [str(logistic(c)) for c in strengths]
    total = sum(fold_sizes(data).values())
    return _ranked(data.sparkSession, ["logistic"] * len(names), names, scores, total)


def search_margins(
    data: DataFrame, kind: str, recipes: Sequence[Recipe] | None = None
) -> tuple[DataFrame, dict[str, MarginModel]]:
    """Mean weighted F1 per setting of ``linear_svm`` or ``hinge_linear`` with the largest duality
    gap of the setting's fits (``gap``, share of the loss), and each setting's model of all rows.

    All settings are fitted together, on all folds and on all rows.
    """
    recipes = grid(kind) if recipes is None else recipes
    rows = model_rows(data).cache()
    try:
        sizes = fold_sizes(rows)
        total, folds = sum(sizes.values()), sorted(sizes)

        def fit(recipe: Recipe, fold: int | None) -> MarginFit:
            return MarginFit(recipe.strength(total - (0 if fold is None else sizes[fold])), fold)

        fits = [fit(recipe, fold) for recipe in recipes for fold in folds]
        weights, gaps = fit_margins(rows, fits + [fit(recipe, None) for recipe in recipes])
        scores = fold_scores(
            rows, [Fit((), f.c, f.left_out) for f in fits], weights[: len(fits)]
        )
    finally:
        rows.unpersist()
    n, spark = len(folds), data.sparkSession
    names = list(map(str, recipes))
    means = [sum(scores[i * n : (i + 1) * n]) / n for i in range(len(names))]
    models = {
        name: MarginModel(w[:-1].tolist(), float(w[-1]), float(g))
        for name, w, g in zip(names, weights[len(fits) :], gaps[len(fits) :])
    }
    worst = [
        (name, float(max(gaps[i * n : (i + 1) * n].max(), models[name].gap)))
        for i, name in enumerate(names)
    ]
    ranking = _ranked(spark, [kind] * len(names), names, means, total)
    bounds = spark.createDataFrame(worst, "settings string, gap double")
    return ranking.join(bounds, "settings").select(*ranking.columns, "gap"), models


def search_neighbors(data: DataFrame, counts: Sequence[int] = NEIGHBOR_GRID) -> DataFrame:
    """Mean weighted F1 of the nearest-neighbour vote per neighbour count.

    Neighbours are found once, for the largest count and among the rows of other folds;
    smaller counts use the first of them. All votes of all folds are scored together.
    """
    rows = data.select("key", "label", "fold", vector_to_array("features").alias("vector")).cache()
    try:
        near = nearest(rows, rows, max(counts), "key", "vector", apart="fold")
        labels = rows.select(F.col("key").alias("neighbor"), F.col("label").alias("vote"))
        tallied = near.join(labels, "neighbor").groupBy("query").agg(
            *[
                F.count_if((F.col("place") <= k) & (F.col("vote") == 1)).alias(f"n{k}")
                for k in counts
            ]
        )
        # More than half the votes: a tie goes to label 0.
        guesses = [
            F.struct(F.lit(k).alias("k"), (2 * F.col(f"n{k}") > k).cast("int").alias("prediction"))
            for k in counts
        ]
        actual = rows.select(F.col("key").alias("query"), "label", "fold")
        votes = tallied.join(actual, "query").select(
            "fold", "label", F.explode(F.array(*guesses)).alias("g")
        )
        scores = weighted_metrics(
            votes.select("fold", "label", "g.*"), by=["fold", "k"]
        )
        means = {r.k: r.f1 for r in scores.groupBy("k").agg(F.avg("f1").alias("f1")).collect()}
        total = tallied.count()
    finally:
        rows.unpersist()
    names = [f"n_neighbors={k}" for k in counts]
    return _ranked(
        data.sparkSession, ["neighbors"] * len(names), names, [means[k] for k in counts], total
    )


def weights_of(model) -> list[float]:
    """Weights of a fitted linear model, one per feature."""
    return [float(w) for w in model.coefficients]


def feature_weights(model, width: int) -> list[float]:
    """Weights of a linear model's features; of trees, how much each feature serves their splits
    (for several trees the mean)."""
    if hasattr(model, "coefficients"):
        return weights_of(model)
    return model.importances()


def select_features(train: DataFrame, features: Sequence[str], c: float = SELECTION_C) -> list[str]:
    """Features that keep a weight under an absolute-value penalty."""
    train = train.cache()
    model = logistic(c, l1=True).fit(train, train.count())
    train.unpersist()
    return [name for name, weight in zip(features, weights_of(model)) if weight != 0.0]


def drop_one_impact(data: DataFrame, features: Sequence[str], c: float = FINAL_C) -> DataFrame:
    """Change of the mean weighted F1 when one feature is left out: (feature, impact)."""
    everything = range(len(features))
    subsets = [list(everything)] + [[j for j in everything if j != i] for i in everything]
    scores = cross_validated(data, [(some, c) for some in subsets])
    rows = [(name, score - scores[0]) for name, score in zip(features, scores[1:])]
    return data.sparkSession.createDataFrame(rows, "feature string, impact double")


def most_missed(impacts: DataFrame, count: int = KEPT_FEATURES) -> DataFrame:
    """The features whose loss hurts most, at most ``count``."""
    return impacts.where("impact < 0").orderBy("impact", "feature").limit(count)


def coefficient_report(spark, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Nonzero weights by falling size, with the factor each puts on the odds."""
    rows = spark.createDataFrame(
        list(zip(features, map(float, weights))), "feature string, coefficient double"
    )
    return (
        rows.where("coefficient <> 0")
        .withColumn("odds_factor", F.exp("coefficient"))
        .orderBy(F.abs("coefficient").desc(), "feature")
    )
