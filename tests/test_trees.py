"""Trees grown together, against trees grown by trying every border of every feature."""

import pickle

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from custvalue.models import trees_many
from custvalue.models.classifiers import bagging, decision_tree, random_forest
from custvalue.models.search import search
from custvalue.models.trees_many import (
    Forest,
    Rule,
    Tree,
    forest_guesses,
    importances,
    poisson_draws,
    tree_rows,
    votes,
)


def made_up(n=300, seed=5):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 3)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0.1) ^ (random.random(n) < 0.1)).astype(int)
    return x, y, np.arange(n) % 4


def frame(spark, x, y, fold, parts=3):
    rows = [(i, int(t), int(f), Vectors.dense(v)) for i, (v, t, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, ["key", "label", "fold", "features"]).repartition(parts)


def impurity(y, w, criterion):
    shares = [w[y == k].sum() / w.sum() for k in (0, 1)]
    if criterion == "gini":
        return 1 - sum(s * s for s in shares)
    return -sum(s * np.log2(s) for s in shares if s > 0)


def plain_tree(x, y, w, criterion, least, depth):
    """Nested (feature, border, low, high), or the chance of label 1 in a leaf."""
    p = (w * y).sum() / w.sum()
    if depth == 0 or len(y) < least or p in (0.0, 1.0):
        return p
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            cost = sum(
                w[side].sum() * impurity(y[side], w[side], criterion) for side in (low, ~low)
            )
            if best is None or cost < best[0] - 1e-9:
                best = cost, f, (a + b) / 2, low
    if best is None:
        return p
    _, f, border, low = best
    sides = [plain_tree(x[s], y[s], w[s], criterion, least, depth - 1) for s in (low, ~low)]
    return f, border, *sides


def plain_chance(tree, row):
    while isinstance(tree, tuple):
        f, border, low, high = tree
        tree = low if row[f] <= border else high
    return tree


@pytest.mark.parametrize(
    "criterion,share,depth", [("gini", 0.2, 3), ("entropy", 0.1, 99), ("gini", 1.0, 99)]
)
def test_votes_equal_those_of_exhaustive_trees(spark, criterion, share, depth):
    x, y, fold = made_up()
    tree = Tree(Rule(criterion, share), 0, 2, 225, (1, depth))
    got = {r.key: r.p for r in votes(tree_rows(frame(spark, x, y, fold)), [tree]).collect()}
    assert set(got) == set(np.flatnonzero(fold == 2))
    some = fold != 2
    for place, levels in enumerate((1, depth)):
        least = max(2, share * 225)
        plain = plain_tree(x[some], y[some], np.ones(some.sum()), criterion, least, levels)
        assert all(abs(got[k][place] - plain_chance(plain, x[k])) < 1e-9 for k in got)


def test_drawn_rows_count_as_often_as_drawn(spark):
    x, y, fold = made_up()
    data = frame(spark, x, y, fold)
    drawn = data.select("key", poisson_draws(0.7, 4).alias("w")).collect()
    w = np.array([r.w for r in sorted(drawn)])
    tree = Tree(Rule("gini", 0.15, sample=0.7), 4, 1, 225, (3,))
    got = {r.key: r.p[0] for r in votes(tree_rows(data), [tree]).collect()}
    some = (fold != 1) & (w > 0)
    plain = plain_tree(x[some], y[some], w[some], "gini", 0.15 * 225, 3)
    assert all(abs(p - plain_chance(plain, x[k])) < 1e-9 for k, p in got.items())


@pytest.mark.parametrize("few", [40, 90, 299])
def test_nodes_with_many_rows_are_split_like_small_ones(spark, few, monkeypatch):
    x, y, fold = made_up()
    x = x.round(1)
    monkeypatch.setattr(trees_many, "_CELLS_AT_ONCE", 5_000)
    rows = tree_rows(frame(spark, x, y, fold))
    trees = [Tree(Rule("gini", 0.1), 0, f, 225, (1, 2, 4)) for f in range(4)]
    whole = sorted(votes(rows, trees).collect())
    parts = sorted(votes(rows, trees, few).collect())
    assert [r[:3] for r in whole] == [r[:3] for r in parts] and len(whole) == 300
    near = [np.allclose(a.p, b.p) for a, b in zip(whole, parts)]
    # Borders lie on values, not between two, so rows of another fold may fall elsewhere.
    assert np.mean(near) > 0.9
    assert np.allclose(importances(rows, trees), importances(rows, trees, few))


def test_fewer_trees_and_lower_depths_are_tops_of_more(spark):
    x, y, fold = made_up()
    data = frame(spark, x, y, fold)
    sizes = {f: 75 for f in range(4)}
    rule = Rule(tree_share=0.5, node_share=None, sample=1.0)
    some = [Forest(rule, n, d) for n in (1, 4) for d in (2, 99)]
    together = forest_guesses(tree_rows(data), some, sizes)
    for i, forest in enumerate(some):
        alone = forest_guesses(tree_rows(data), [forest], sizes).drop("forest")
        same = together.where(F.col("forest") == i).drop("forest")
        assert alone.exceptAll(same).count() == 0 and same.count() == 300


def test_trees_do_not_depend_on_how_rows_lie(spark):
    x, y, fold = made_up()
    trees = [Tree(Rule(node_share=None, tree_share=0.7, sample=0.5), i, 0, 225) for i in range(3)]
    one = votes(tree_rows(frame(spark, x, y, fold, 1)), trees)
    many = votes(tree_rows(frame(spark, x, y, fold, 7)), trees)
    assert sorted(one.collect()) == sorted(many.collect())


def test_a_deep_chain_grows_to_its_end(spark):
    n = 120
    x, y = np.arange(n, dtype=float)[:, None], np.arange(n) % 2
    data = frame(spark, x, y, np.zeros(n))
    model = decision_tree("gini", 10_000, 0.0, 1.0).fit(data, n)
    assert model.transform(data).where("prediction <> label").count() == 0
    assert model.importances() == [1.0]


def test_rows_of_one_kind_and_of_equal_features(spark):
    x = np.ones((20, 2))
    for y in (np.ones(20), np.zeros(20), np.arange(20) % 4 == 0):
        data = frame(spark, x, np.asarray(y, int), np.arange(20) % 2)
        for recipe in (decision_tree("gini", 5, 0.1, 0.5), bagging(2, 0.5, 0.5)):
            model = recipe.fit(data, 20)
            expected = float(np.mean(y) > 0.5)
            assert {r.prediction for r in model.transform(data).collect()} == {expected}
            assert model.importances() == [0.0, 0.0]
    with pytest.raises(ValueError):
        votes(tree_rows(data.limit(0)), [Tree(Rule(), 0, 0, 0)])


def test_the_joint_search_scores_as_single_fits_do(spark):
    x, y, fold = made_up()
    data = frame(spark, x, y, fold)
    recipes = [random_forest(0.25, 5, 3), bagging(5, 0.5, 1.0), decision_tree("gini", 4, 0.1, 0.7)]
    got = {r.settings: r.mean_f1 for r in search(data, recipes).collect()}
    for recipe in recipes:
        scores = []
        for f in range(4):
            train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
            guess = recipe.fit(train, 225).transform(test).select("label", "prediction").collect()
            label = np.array([r.label for r in guess])
            made = np.array([r.prediction for r in guess])
            f1 = 0.0
            for k in (0, 1):
                hits = ((label == k) & (made == k)).sum()
                f1 += 2 * hits / max(1, (label == k).sum() + (made == k).sum()) * (label == k).mean()
            scores.append(f1)
        assert abs(got[str(recipe)] - np.mean(scores)) < 1e-9


def test_leaves_of_tops_need_no_rows_to_meet(spark):
    """Below the least rows for a split nothing grows: no row is packed, and all get votes."""
    x, y, fold = made_up()
    rows = tree_rows(frame(spark, x, y, fold))
    trees = [Tree(Rule("gini", 0.5, sample=1.0), i, 2, 225, (1, 9)) for i in range(2)]
    prepared, trees, places, tops, _, _ = trees_many._prepared(rows, trees, 100)
    assert trees_many._at_nodes(prepared, trees, places, tops, asked=True).count() == 0
    got = votes(rows, trees, 100).collect()
    assert len(got) == 150 and sorted(r[:3] for r in got) == sorted(
        r[:3] for r in votes(rows, trees).collect()
    )


def test_counts_of_forests_are_those_of_their_guesses(spark):
    x, y, fold = made_up()
    rows, sizes = tree_rows(frame(spark, x, y, fold)), {f: 75 for f in range(4)}
    rule = Rule("gini", 0.1)
    forests = [Forest(rule, 1, 2), Forest(Rule("gini", 0.2, sample=1.0), 3, 4), Forest(rule, 1, 9)]
    counts = trees_many.forest_counts(rows, forests, sizes, 100)
    by_row = forest_guesses(rows, forests, sizes, 100).groupBy(
        "forest", "fold", "label", "prediction"
    ).count()
    total = counts.groupBy("forest", "fold", "label", "prediction").sum("n")
    assert sorted(total.collect()) == sorted(by_row.collect())


def test_the_driver_gets_no_histograms(spark, monkeypatch):
    """What a pass brings to the driver does not grow with features, slices or tasks."""
    x, y, fold = made_up()
    rows = tree_rows(frame(spark, x, y, fold))
    trees = [Tree(Rule(tree_share=0.7, sample=1.0), i, 2, 225) for i in range(3)]
    collect, sizes = type(rows).collect, []

    def measured(df):
        found = collect(df)
        sizes.extend(len(pickle.dumps(row)) for row in found)
        return found

    monkeypatch.setattr(type(rows), "collect", measured)
    tops = trees_many._prepared(rows, trees, 40)[3]
    assert all(len(top.state) > 3 for top in tops)
    assert max(sizes) < 2_000


def test_histograms_travel_in_few_bytes():
    for top in (0, 1, 255, 256, 70_000, 2**33):
        counts = np.array([[0, 1, top], [top, 0, 0]], np.float64)
        data = trees_many._packed(counts)
        assert len(data) == 6 * np.min_scalar_type(max(top, 1)).itemsize
        assert (trees_many._unpacked(data, (2, 3)) == counts).all()


def test_a_sample_without_rows_is_a_leaf(spark):
    x, y, fold = made_up(40)
    rows = tree_rows(frame(spark, x, y, fold))
    tree = Tree(Rule(sample=1e-9), 0, 1, 30)
    for few in (5, None):
        assert {tuple(r.p) for r in votes(rows, [tree], few).collect()} == {(0.0,)}
