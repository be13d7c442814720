import numpy as np
import pytest
from pyspark.sql import functions as F

from custvalue.models import margin_many
from custvalue.models.classifiers import hinge_linear, linear_svm
from custvalue.models.logistic_many import model_rows
from custvalue.models.margin_many import MarginFit, fit_margins
from custvalue.models.search import search_margins
from pyspark.ml.linalg import Vectors


def made_up(n=400, size=4, seed=3):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, size))
    y = (x @ [1.5, -1, 0.5, 0][:size] + 0.4 + random.normal(size=n) > 0).astype(int)
    return x, y, np.arange(n) % 5


@pytest.fixture(scope="module")
def data(spark):
    x, y, fold = made_up()
    rows = [(i, int(t), int(f), Vectors.dense(v)) for i, (v, t, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, ["key", "label", "fold", "features"]).repartition(3).cache()


def primal(x, y, w, c):
    miss = 1 - np.where(y > 0, 1, -1) * (x @ w[:-1] + w[-1])
    return np.maximum(miss, 0).sum() + (w[:-1] ** 2).sum() / (2 * c)


def long_run(x, y, c, steps=20_000):
    """Averaged subgradient descent: slow, but from the definition alone."""
    sign, w, best = np.where(y > 0, 1, -1), np.zeros(x.shape[1] + 1), np.inf
    xs = np.hstack([x, np.ones((len(x), 1))])
    for i in range(1, steps + 1):
        hit = (1 - sign * (xs @ w) > 0) * sign
        slope = -(hit[:, None] * xs).sum(axis=0) + np.append(w[:-1] / c, 0)
        w = w - slope / (np.linalg.norm(slope) + 1e-12) * 2 / i**0.5
        best = min(best, primal(x, y, w, c))
    return best


@pytest.mark.parametrize("c", [20.0])
def test_loss_is_within_the_gap_of_a_long_run(data, c):
    x, y, fold = made_up()
    rows = model_rows(data).cache()
    weights, gaps = fit_margins(rows, [MarginFit(c, 2), MarginFit(c)])
    assert (gaps >= -1e-9).all() and (gaps <= margin_many.GAP).all()
    for w, some in zip(weights, (fold != 2, fold >= 0)):
        best = long_run(x[some], y[some], c)
        assert primal(x[some], y[some], w, c) <= best * (1 + margin_many.GAP)


def test_separable_rows_and_one_label_settle(spark):
    rows = [(0.0, -1, [float(i)]) for i in range(5)]
    rows += [(1.0, -1, [float(i + 9)]) for i in range(5)]
    df = spark.createDataFrame(rows, "label double, fold int, x array<double>")
    (w,), (gap,) = fit_margins(df, [MarginFit(10.0)])
    assert gap <= margin_many.GAP and [w[0] * v[2][0] + w[1] > 0 for v in rows] == [False] * 5 + [True] * 5
    (w,), _ = fit_margins(df.where("label = 1"), [MarginFit(1.0)])
    assert w[0] * 9 + w[1] > 0


def test_no_rows_and_too_wide_gaps_are_errors(spark, data, monkeypatch):
    monkeypatch.setattr(margin_many, "_WIDTHS", margin_many._WIDTHS[:3])
    rows = model_rows(data)
    with pytest.raises(ValueError, match="no rows"):
        fit_margins(rows.limit(0), [MarginFit(1.0)])
    with pytest.raises(RuntimeError, match="did not come closer"):
        fit_margins(rows, [MarginFit(1.0)], gap=-1.0)


@pytest.mark.parametrize("kind", ["hinge_linear"])
def test_search_scores_as_fits_one_by_one(data, kind):
    recipes = {
        "linear_svm": [linear_svm(0.05), linear_svm(5.0)],
        "hinge_linear": [hinge_linear(1e-3), hinge_linear(1.0)],
    }[kind]
    ranking, models = search_margins(data, kind, recipes)
    found = {r.settings: r for r in ranking.collect()}
    for recipe in recipes:
        model = recipe.fit(data, data.count())
        assert models[str(recipe)].coefficients == pytest.approx(model.coefficients, abs=0.05)
        assert found[str(recipe)].gap <= margin_many.GAP
        hits = model.transform(data).where(F.col("prediction") == F.col("label")).count()
        assert abs(hits / data.count() - found[str(recipe)].mean_f1) < 0.05


def test_fits_with_few_rows_in_the_kink_come_close(spark):
    """Nearly separable rows: at small widths hardly a row lies in the kink."""
    from custvalue.bindings.model_jobs import _vectors
    from custvalue.operators.splits import with_folds

    vectors, _ = _vectors(spark, "/root/testdata/sf0.001")
    rows = model_rows(with_folds(vectors, "label", "key")).cache()
    _, gaps = fit_margins(rows, [MarginFit(5.0, 2), MarginFit(5.0, 1), MarginFit(5.0)])
    assert (gaps <= margin_many.GAP).all()
