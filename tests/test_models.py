"""Feature preparation and models against numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from custvalue.models import search as S
from custvalue.models.classifiers import (
    ada_boost,
    bagging,
    decision_tree,
    hinge_linear,
    linear_svm,
    logistic,
    random_forest,
)
from custvalue.models.logistic_many import Fit, cross_validated, fit_many, model_rows
from custvalue.models.metrics import weighted_metrics
from custvalue.models.revenue import compare_revenue_models
from custvalue.operators import features as P
from custvalue.operators.splits import with_folds
from custvalue.plans.modeling import fit_license_model, prepare_features


def labelled(rows, n=300, width=4, seed=0):
    """(DataFrame, x, y) of a noisy linear rule."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) * np.array([1.0, 3.0, 0.2, 1.0])[:width]
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, n) > 0.3).astype(int)
    data = [(i, int(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    df = rows([(i, t, v) for i, t, v in data], ["key", "label", "features"])
    return df.withColumn("label", F.col("label").cast("int")).coalesce(1).cache(), x, y


def weighted_f1(y, guess):
    total = 0.0
    for c in np.unique(y):
        hits = np.sum((y == c) & (guess == c))
        total += 2 * hits / (np.sum(y == c) + np.sum(guess == c)) * np.sum(y == c)
    return total / len(y)


def newton(x, y, c):
    """Weights and intercept that minimise c * loss + |w|^2 / 2."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(full.shape[1]), np.array([1 / c] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        slope = full.T @ (p - y) + penalty * w
        curvature = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        w -= np.linalg.solve(curvature, slope)
    return w


def coordinate_descent(x, y, alpha, l1_ratio):
    """Elastic net with intercept: |y - xw|^2 / 2n + alpha * (l1_ratio |w| + (1-l1_ratio)/2 w^2)."""
    mean_x, mean_y = x.mean(axis=0), y.mean()
    x, y = x - mean_x, y - mean_y
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(x.shape[1]):
            rest = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ rest / n
            size = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0)
            w[j] = size / ((x[:, j] ** 2).sum() / n + alpha * (1 - l1_ratio))
    return w, mean_y - mean_x @ w


def test_elastic_net_minimises_the_plain_formula(rows):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 3)) * [1, 5, 0.3]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 1, 200) + 7
    df = rows([(float(t), Vectors.dense(v)) for t, v in zip(y, x)], ["label", "features"])
    model = P.elastic_net("label", float(np.std(y, ddof=1)), 0.1, 0.5).fit(df)
    w, b = coordinate_descent(x, y, 0.1, 0.5)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-3)
    assert abs(model.intercept - b) < 1e-2


def test_unknown_numbers_are_predicted(rows):
    rng = np.random.default_rng(2)
    n = 240
    a = rng.normal(0, 2, n)
    b = rng.normal(5, 1, n)
    c = 2 * a - b + rng.normal(0, 0.1, n)
    table = np.stack([a, b, c], axis=1)
    holes = table.copy()
    holes[::5, 2] = np.nan
    holes[1::7, 1] = np.nan
    data = [
        (i, int(i >= 180), *[None if np.isnan(v) else float(v) for v in row])
        for i, row in enumerate(holes)
    ]
    df = rows(data, "id int, test int, a double, b double, c double")
    train, test = df.where("test = 0"), df.where("test = 1")
    names = ["a", "b", "c"]
    got_train, got_test = P.predict_missing(train, test, names, names)
    got = {r.id: (r.a, r.b, r.c) for r in got_train.unionByName(got_test).collect()}

    # b first, with unknown c at its train mean, then c with the predicted b.
    known = holes[:180]
    means = np.nanmean(known, axis=0)
    work = holes.copy()
    for target, others in ((1, [0, 2]), (2, [0, 1])):
        filled = np.where(np.isnan(work), means, work)
        rows_known = ~np.isnan(work[:180, target])
        w, intercept = coordinate_descent(
            filled[:180][rows_known][:, others], work[:180, target][rows_known], 0.1, 0.5
        )
        hole = np.isnan(work[:, target])
        work[hole, target] = (filled[:, others] @ w + intercept)[hole]
    assert np.allclose([got[i] for i in range(n)], work, atol=2e-2)
    known_cells = ~np.isnan(holes)
    assert np.array_equal(np.array([got[i] for i in range(n)])[known_cells], holes[known_cells])


def test_columns_that_stay_unknown_are_dropped(rows):
    train = rows([(1.0, None, 2.0)], "a double, b double, c double")
    test = rows([(1.0, 1.0, None)], "a double, b double, c double")
    train, test, kept = P.without_null_columns(train, test, ["a", "b", "c"])
    assert kept == ["a"] and train.columns == ["a"] and test.columns == ["a"]


def test_scaling_uses_the_population_deviation(rows):
    df = rows([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scales = P.scaling(df, ["a", "b"])
    assert scales == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert [tuple(r) for r in P.scaled(df, scales).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_dummies_drop_the_first_value(rows):
    df = rows([("a", 1.0), ("b", 0.0), (None, 1.0)], "c string, f double")
    got = P.dummies(df, ["c", "f"])
    assert got.columns == ["c_b", "f_1.0"]
    assert [tuple(r) for r in got.collect()] == [(0, 1), (1, 0), (0, 1)]
    with pytest.raises(ValueError):
        P.dummies(rows([(str(i),) for i in range(30)], "c string"), ["c"], limit=10)


def test_weighted_metrics_by_hand(rows):
    pairs = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 0)] * 4 + [(0, 1)]
    got = weighted_metrics(rows(pairs, "label int, prediction int")).first()
    p1, r1, p0, r0 = 3 / 4, 3 / 5, 4 / 6, 4 / 5
    f1, f0 = 2 * p1 * r1 / (p1 + r1), 2 * p0 * r0 / (p0 + r0)
    assert np.allclose(
        [got.f1, got.precision, got.recall, got.accuracy],
        [(f1 + f0) / 2, (p1 + p0) / 2, (r1 + r0) / 2, 0.7],
    )


def test_a_class_never_predicted_scores_zero(rows):
    got = weighted_metrics(rows([(1, 0), (0, 0)], "label int, prediction int")).first()
    assert (got.precision, got.recall) == (0.25, 0.5)
    assert abs(got.f1 - (2 / 3) / 2) < 1e-12


def test_logistic_equals_a_newton_solution(rows):
    df, x, y = labelled(rows)
    expected = newton(x, y, 17.0)
    model = logistic(17.0).fit(df, len(y))
    assert np.allclose([*model.coefficients, model.intercept], expected, atol=1e-3)
    together = fit_many(model_rows(df.repartition(3)), [Fit((0, 1, 2, 3), 17.0), Fit((0, 2), 5.0)])
    assert np.allclose(together[0], expected, atol=1e-6)
    part = newton(x[:, [0, 2]], y, 5.0)
    assert np.allclose(together[1], [part[0], 0, part[1], 0, part[2]], atol=1e-6)


def test_passes_do_not_grow_with_the_features(rows):
    passes = {}
    for width in (50, 300):
        rng = np.random.default_rng(width)
        x = rng.normal(0, 1, (400, width))
        y = (x[:, :5].sum(axis=1) + rng.normal(0, 1, 400) > 0).astype(int)
        data = rows(
            [(i, int(t), i % 2, Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))],
            ["key", "label", "fold", "features"],
        )
        cached = model_rows(data.repartition(2)).cache()
        everything = range(width)
        fits = [
            Fit(tuple(j for j in everything if j != i), 1.0, fold)
            for i in [-1, *range(0, width, max(1, width // 25))] for fold in (0, 1)
        ]
        count = []
        weights = fit_many(cached, fits, lambda: count.append(1))
        passes[width] = len(count)
        folds = np.arange(400) % 2
        for fit, got in list(zip(fits, weights))[::11]:
            some = list(fit.features)
            expected = newton(x[folds != fit.left_out][:, some], y[folds != fit.left_out], 1.0)
            assert np.allclose(got[[*some, width]], expected, atol=1e-5)
        cached.unpersist()
    assert passes[300] <= passes[50] + 6 and passes[300] < 40


def test_fits_that_do_not_settle_are_an_error(rows, monkeypatch):
    from custvalue.models import logistic_many

    monkeypatch.setattr(logistic_many, "_MAX_PASSES", 2)
    df, _, _ = labelled(rows)
    with pytest.raises(RuntimeError, match="did not converge"):
        fit_many(model_rows(df), [Fit((0, 1, 2, 3), 17.0)])


def test_joint_fits_survive_separable_rows(rows):
    x = np.linspace(-1, 1, 40)[:, None] * [100.0]
    y = (x[:, 0] > 0).astype(int)
    data = [(i, int(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    weights = fit_many(model_rows(rows(data, ["key", "label", "features"])), [Fit((0,), 17.0)])[0]
    full = np.hstack([x, np.ones((40, 1))])
    p = 1 / (1 + np.exp(-np.clip(full @ weights, -500, 500)))
    slope = full.T @ (p - y) + np.array([1 / 17.0, 0]) * weights
    assert np.abs(slope).max() < 1e-2


def test_cross_validation_scores_each_fold_alone(rows):
    df, x, y = labelled(rows)
    data = with_folds(df, "label", "key").cache()
    fold = {r.key: r.fold for r in data.select("key", "fold").collect()}
    folds = np.array([fold[i] for i in range(len(y))])
    scores = []
    for f in range(5):
        w = newton(x[folds != f], y[folds != f], 17.0)
        guess = (np.hstack([x, np.ones((len(x), 1))])[folds == f] @ w > 0).astype(int)
        scores.append(weighted_f1(y[folds == f], guess))
    assert abs(cross_validated(data, [(range(4), 17.0)])[0] - np.mean(scores)) < 1e-9
    table = S.search(data, [logistic(17.0)]).first()
    assert abs(table.mean_f1 - np.mean(scores)) < 5e-3


def test_the_best_settings_are_fitted_again(rows):
    df, x, y = labelled(rows)
    data = with_folds(df, "label", "key", folds=2).cache()
    recipes = [logistic(1e-6), logistic(17.0)]
    ranking = S.search(data, recipes)
    assert {r.rows for r in ranking.collect()} == {len(y)}
    recipe, model = S.refitted(data, ranking, recipes)
    assert str(recipe) == str(recipes[1])
    assert np.allclose([*model.coefficients, model.intercept], newton(x, y, 17.0), atol=1e-3)


def test_selection_and_impact_find_the_telling_features(rows):
    df, x, y = labelled(rows, n=400)
    names = ["first", "second", "third", "noise"]
    assert {"first", "second"} <= set(S.select_features(df, names, c=0.05))
    assert S.select_features(df, names, c=0.0005) == []
    impacts = S.drop_one_impact(with_folds(df, "label", "key"), names)
    found = {r.feature: r.impact for r in impacts.collect()}
    assert found["first"] < -0.02 and found["second"] < -0.02
    top = [r.feature for r in S.most_missed(impacts, 2).collect()]
    assert set(top) == {"first", "second"}


def test_report_sorts_and_drops_zero_weights(spark):
    got = S.coefficient_report(spark, ["a", "b", "c"], [0.5, 0.0, -2.0]).collect()
    assert [(r.feature, r.coefficient) for r in got] == [("c", -2.0), ("a", 0.5)]
    assert abs(got[0].odds_factor - np.exp(-2.0)) < 1e-12
    assert abs(np.exp(4.0302363383517417) - 56.3) < 0.05


def real_boost(x, y, rounds, rate):
    """Stump boosting on class probabilities with exhaustive splits."""
    weight, members = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                score, p = 0.0, []
                for side in (left, ~left):
                    total = weight[side].sum()
                    share = weight[side & (y == 1)].sum() / total
                    score += total * 2 * share * (1 - share)
                    p.append(share)
                if best is None or score < best[0] - 1e-12:
                    best = (score, j, cut, p)
        _, j, cut, p = best
        members.append((j, cut, p))
        chance = np.where(x[:, j] <= cut, p[0], p[1])
        eps = np.finfo(float).eps
        odds = np.log(np.maximum(chance, eps)) - np.log(np.maximum(1 - chance, eps))
        weight = weight * np.exp(-0.5 * rate * np.where(y == 1, 1, -1) * odds)
    total = np.zeros(len(y))
    for j, cut, p in members:
        chance = np.where(x[:, j] <= cut, p[0], p[1])
        eps = np.finfo(float).eps
        total += np.log(np.maximum(chance, eps)) - np.log(np.maximum(1 - chance, eps))
    return (total > 0).astype(int)


def test_boosting_equals_exhaustive_stumps(rows):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 5) ^ (rng.random(120) < 0.1)).astype(int)
    data = [(i, int(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    df = rows(data, ["key", "label", "features"])
    model = ada_boost(7, 0.9).fit(df, 120)
    got = {r.key: int(r.prediction) for r in model.transform(df).collect()}
    assert [got[i] for i in range(120)] == list(real_boost(x, y, 7, 0.9))


@pytest.mark.parametrize(
    "recipe",
    [
        linear_svm(5.0),
        hinge_linear(1e-4),
        decision_tree("entropy", 99, 0.1, 0.8),
        random_forest(0.25, 5),
        bagging(5, 0.5, 0.5),
    ],
    ids=lambda r: r.kind,
)
def test_each_classifier_learns(rows, recipe):
    df, x, y = labelled(rows)
    predicted = recipe.fit(df, len(y)).transform(df)
    assert S.f1_of(predicted) > 0.7
    assert predicted.count() == len(y)


def test_bagging_draws_the_same_sample_again(rows):
    from custvalue.models.trees_many import poisson_draws

    df = rows([(i,) for i in range(4000)], "key int")
    drawn = df.select("key", poisson_draws(0.5, 3).alias("d"))
    assert abs(drawn.agg(F.avg("d")).first()[0] - 0.5) < 0.05
    again = df.repartition(5).select("key", poisson_draws(0.5, 3).alias("d"))
    assert drawn.exceptAll(again).count() == 0


def test_grids_have_the_stated_sizes():
    sizes = {k: len(S.grid(k)) for k in (
        "logistic", "decision_tree", "linear_svm", "hinge_linear", "random_forest", "bagging",
        "ada_boost",
    )}
    assert sizes == {
        "logistic": 10, "decision_tree": 344, "linear_svm": 10, "hinge_linear": 10,
        "random_forest": 9, "bagging": 12, "ada_boost": 9,
    }
    # A split may take a single row off, so no two depths are known to give the same tree.
    assert len({r.identity for r in S.grid("decision_tree")}) == 344
    with pytest.raises(ValueError):
        S.grid("unknown")


def test_neighbor_search_agrees_with_brute_force(rows):
    df, x, y = labelled(rows, n=120)
    data = with_folds(df, "label", "key", folds=3).cache()
    fold = {r.key: r.fold for r in data.select("key", "fold").collect()}
    folds = np.array([fold[i] for i in range(120)])
    got = {r.settings: r.mean_f1 for r in S.search_neighbors(data, [2, 5]).collect()}
    for k in (2, 5):
        scores = []
        for f in range(3):
            train = np.flatnonzero(folds != f)
            guess = []
            for i in np.flatnonzero(folds == f):
                distance = np.sqrt(((x[train] - x[i]) ** 2).sum(axis=1))
                votes = y[train[np.lexsort((train, distance))[:k]]]
                guess.append(int(2 * votes.sum() > k))
            scores.append(weighted_f1(y[folds == f], np.array(guess)))
        assert abs(got[f"n_neighbors={k}"] - np.mean(scores)) < 1e-9


def test_revenue_models_compare(rows):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 2))
    y = 10 * x[:, 0] + rng.normal(0, 1, 200)
    data = [(i, float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    df = rows(data, ["key", "label", "features"])
    train, test = df.where("key < 150"), df.where("key >= 150")
    got = {r.model: r.r2 for r in compare_revenue_models(train, test).collect()}
    assert set(got) == {"elastic_net", "decision_tree", "random_forest", "neighbors"}
    assert got["elastic_net"] > 0.95 and got["neighbors"] > 0.8


def test_from_customer_table_to_model(rows):
    rng = np.random.default_rng(8)
    data = []
    for i in range(400):
        industry = ["retail", "travel", "art", None][rng.integers(0, 4)]
        spend = float(rng.normal(10, 3))
        label = int((industry == "retail") * 2 + 0.3 * spend + rng.normal(0, 1) > 4.2)
        data.append((
            i, label if i % 9 else (label or None), industry, spend if i % 6 else None, i % 2, 5,
            f"mail{i}", ["x"],
        ))
    schema = (
        "id int, target int, industry string, spend double, flag int, same int, email string, "
        "segments array<string>"
    )
    prepared = prepare_features(rows(data, schema), "id", "target", drop=["email"])
    assert prepared.features == ["spend", "industry_retail", "industry_travel", "flag_1"]
    assert prepared.test.count() == 100
    model = fit_license_model(prepared)
    assert "industry_retail" in model.features
    assert model.coefficients.first().feature == "industry_retail"
    assert model.metrics.first().accuracy > 0.7
    assert model.predictions.count() == prepared.test.count()


def test_whole_grids_and_refits_are_registered():
    import __spark_entry__ as entry

    kinds = entry.model_jobs._OTHER_KINDS
    assert len(kinds) == 6
    for kind in kinds:
        assert {f"{kind}_search", f"{kind}_refit"} <= set(entry.queries())


def test_feature_weights_of_every_kind(rows):
    df, x, y = labelled(rows, n=200)
    for kind in ("linear_svm", "random_forest", "bagging", "ada_boost"):
        recipe = S.grid(kind)[0]
        weights = S.feature_weights(recipe.fit(df, 200), 4)
        assert len(weights) == 4 and any(weights)


def test_a_search_takes_five_folds_and_the_best_is_refitted(spark, monkeypatch):
    import __spark_entry__ as entry

    some = S.grid("random_forest")[:2]
    folds, kept = [], S.search
    monkeypatch.setattr(S, "grid", lambda kind: some)
    monkeypatch.setattr(
        S, "search", lambda data, recipes: folds.append(S.fold_sizes(data)) or kept(data, recipes)
    )
    folder = "/root/testdata/sf0.001"
    ranking = entry.queries()["random_forest_search"](spark, folder).collect()
    assert {r.settings for r in ranking} == set(map(str, some)) and len(folds[0]) == 5
    refit = entry.queries()["random_forest_refit"](spark, folder).collect()
    assert {r.settings for r in refit} == {ranking[0].settings}
    assert len({r.feature for r in refit}) == len(refit) > 10


def test_boosting_of_all_rates_and_folds_shares_passes(rows, monkeypatch):
    """One pass per round for the whole grid, with the scores of fits one by one."""
    from custvalue.models import boost_many
    from custvalue.models.classifiers import ada_boost as recipe

    df, x, y = labelled(rows, n=120)
    data = df.withColumn("fold", (F.col("key") % 3).cast("int")).cache()
    passes, kept = [], boost_many._weights_by_slice
    monkeypatch.setattr(
        boost_many, "_weights_by_slice", lambda *a: passes.append(1) or kept(*a)
    )
    some = [recipe(2, 0.5), recipe(4, 0.5), recipe(4, 0.1)]
    found = {r.settings: r.mean_f1 for r in S.search(data, some).collect()}
    assert len(passes) == 4
    one = [
        S.f1_of(some[0].fit(data.where(f"fold <> {i}"), 80).transform(data.where(f"fold = {i}")))
        for i in range(3)
    ]
    # Borders lie half way between values seen, with or without the fold left out.
    assert found[str(some[0])] == pytest.approx(sum(one) / 3, abs=0.02)


def test_revenue_models_predict_once_for_all_scores(rows, monkeypatch):
    """Scores read held predictions: the neighbours are not searched again for each."""
    from custvalue.models import revenue

    df, x, _ = labelled(rows, n=60)
    df = df.withColumn("label", F.col("key") * 1.0)
    kept, seen = revenue.held, []
    monkeypatch.setattr(revenue, "held", lambda d: seen.append(d.columns) or kept(d))
    found = revenue.compare_revenue_models(df.where("key >= 15"), df.where("key < 15")).collect()
    assert {r.rows for r in found} == {15} and seen == [["label", "prediction"]] * 4
