"""Queries for splits, neighbours, imputation and models on a customer feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from custvalue.bindings import standins as S
from custvalue.bindings.customer_jobs import PAID_SQL, customer_table
from custvalue.bindings.registry import query, table
from custvalue.functions.nulls import named
from custvalue.models import search as model_search
from custvalue.models.logistic_many import Fit, fit_many, model_rows
from custvalue.models.margin_many import GAP
from custvalue.models.metrics import weighted_metrics as weighted_scores
from custvalue.models.revenue import compare_revenue_models
from custvalue.operators.aggregates import one_hot
from custvalue.operators.columns import with_label
from custvalue.operators.features import (
    as_vectors,
    mean_filled,
    predict_missing,
    scaled,
    scaling,
)
from custvalue.operators.neighbors import knn_votes, nearest, over_sample
from custvalue.operators.splits import stratified_split as split_rows
from custvalue.operators.splits import with_folds
from custvalue.plans.modeling import FeatureSet, fit_license_model, prepare_features
from custvalue.session import held


@query(
    # A quarter of all rows, rounded up, over the classes by largest remainder.
    "WITH sizes AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), "
    "total AS (SELECT sum(n) AS rows, ceil(sum(n) * 0.25) AS test FROM sizes), "
    "exact AS (SELECT o_orderstatus, n, test, n * test / rows AS x FROM sizes, total), "
    "ranked AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, o_orderstatus) AS place, "
    "test - sum(floor(x)) OVER () AS extra FROM exact), "
    "given AS (SELECT o_orderstatus, n, CAST(floor(x) + (place <= extra)::INTEGER AS BIGINT) AS t "
    "FROM ranked) "
    "SELECT o_orderstatus, 'test' AS part, t AS n FROM given UNION ALL "
    "SELECT o_orderstatus, 'train', n - t FROM given"
)
def stratified_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    train, test = split_rows(orders, "o_orderstatus", "o_orderkey")
    both = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
    return both.groupBy("o_orderstatus", "part").agg(F.count("*").alias("n"))


@query(
    "WITH pairs AS (SELECT q.vec_id AS query, p.vec_id AS neighbor, p.label AS vote, "
    "list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS d "
    "FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id), "
    "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbor) "
    "AS place FROM pairs) WHERE place <= 5), "
    "votes AS (SELECT query, vote, count(*) AS n FROM near GROUP BY 1, 2) "
    "SELECT query, arg_max(vote, (n, -vote)) AS prediction FROM votes GROUP BY 1"
)
def knn_vote(spark, sf):
    vectors = table(spark, sf, "embeddings")
    near = nearest(vectors, vectors, 5, "vec_id", "embedding", apart="vec_id")
    return knn_votes(near, vectors, "vec_id", "label", 5)


def _scores_sql() -> str:
    return (
        "WITH cells AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels "
        "GROUP BY 1, 2), classes AS (SELECT c, "
        "(SELECT coalesce(sum(n), 0) FROM cells WHERE label = c) AS actual, "
        "(SELECT coalesce(sum(n), 0) FROM cells WHERE prediction = c) AS predicted, "
        "(SELECT coalesce(sum(n), 0) FROM cells WHERE label = c AND prediction = c) AS hits "
        "FROM (VALUES (0), (1)) AS v(c)), "
        "scores AS (SELECT actual, hits, "
        "CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, "
        "CASE WHEN actual > 0 THEN hits / actual ELSE 0 END AS r FROM classes) "
        "SELECT round(sum(actual * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) "
        "/ sum(actual), 6) AS f1, round(sum(actual * p) / sum(actual), 6) AS precision, "
        "round(sum(actual * r) / sum(actual), 6) AS recall, "
        "round(sum(hits) / sum(actual), 6) AS accuracy FROM scores"
    )


@query(_scores_sql())
def weighted_metrics(spark, sf):
    scores = weighted_scores(table(spark, sf, "labels"), "quality", "toxic")
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


# --- a feature table of customers --------------------------------------------------------


def feature_table(spark, sf):
    """One row per customer: target licence, segment, nation, balance (unknown for one
    segment), tickets by kind (unknown without tickets) and orders."""
    kinds = ("click", "error", "purchase", "signup", "view")
    events = table(spark, sf, "events").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds],
        F.avg("value").alias("mean_hours"),
    )
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price")
    )
    licenses = S.customer_licenses(spark, sf).select(
        "c_custkey", (F.col("license") == "PROMO").cast("int").alias("promo")
    )
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return (
        table(spark, sf, "customer")
        .select("c_custkey", "c_mktsegment", "c_nationkey", balance.alias("balance"))
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(licenses, "c_custkey", "left")
        .join(events, F.col("c_custkey") == F.col("user_id"), "left")
        .drop("o_custkey", "user_id")
    )


# --- from the customer table to features and model ---------------------------------------

# Identifiers, dates, free texts and addresses: no features.
_NO_FEATURES = [
    "revenue:email", "edd:customer_id", "edd:email", "edd:payment_id", "edd:date",
    "edd:products_(verbose)", "intercom:email", "intercom:first_seen_(mdt)", "drip:email",
    "drip:last", "hubcust:email", "helpscout:emails", "helpscout:id", "hubcomp:company",
    "hubcomp:company_domain_name", "turk:turk_domain", "turk:input.website_url",
]
_PREPARED: dict[tuple[str, str], FeatureSet] = {}


def prepared_customers(spark, sf) -> FeatureSet:
    """The customer table with its features prepared, once per application."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _PREPARED:
        customers = held(customer_table(spark, sf))
        _PREPARED[name] = prepare_features(
            customers, "revenue:id", "edd:licenses_promo", drop=_NO_FEATURES
        )
    return _PREPARED[name]


# Who is in the customer table, whether with the licence, and with how many tickets.
_PEOPLE_SQL = f"""{PAID_SQL}, manual AS (
  SELECT customer_id, max(CASE WHEN method = 'Manual Purchases' THEN 1 ELSE 0 END) AS manual,
         max(CASE WHEN contains(products, 'PROMO License') THEN 1 ELSE 0 END) AS promo
  FROM paid GROUP BY 1),
tally AS (SELECT user_id, count(*) AS tickets FROM events GROUP BY 1),
people AS (
  SELECT c_custkey AS key, coalesce(promo, 0) AS label, greatest(c_acctbal, 0.0) AS value,
         CAST(tickets AS DOUBLE) AS tickets
  FROM customer LEFT JOIN manual ON c_custkey = customer_id
  LEFT JOIN tally ON c_custkey = tally.user_id
  WHERE {S.EMAIL_SQL} NOT IN ('c0@household.com', 'c1@machinery.com')
    AND NOT coalesce(greatest(c_acctbal, 0.0) = 0 AND manual = 1, FALSE))"""


@query(
    f"WITH {_PEOPLE_SQL} SELECT key, label, value, tickets AS known_tickets, "
    "CAST(0 AS BIGINT) AS unknown FROM people"
)
def customer_features(spark, sf):
    """Known values are as they were, and no feature is unknown."""
    prepared = prepared_customers(spark, sf)
    rows = prepared.train.unionByName(prepared.test)
    unknown = sum(
        (named(c).isNull().cast("bigint") for c in prepared.features), F.lit(0).cast("bigint")
    )
    seen = F.greatest(*[named(f"{k}_1") for k in ("click", "error", "purchase", "signup", "view")])
    return rows.select(
        "key", "label", named("revenue:purchase_value").alias("value"),
        F.when(seen == 1, named("helpscout:number_support_tickets")).alias("known_tickets"),
        unknown.alias("unknown"),
    )


def _allotment_sql(source: str, label: str) -> str:
    """Rows of each label in test and train: a quarter, by largest remainder."""
    return (
        f"sizes AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1), "
        "total AS (SELECT sum(n) AS rows, ceil(sum(n) * 0.25) AS test FROM sizes), "
        "exact AS (SELECT label, n, test, n * test / rows AS x FROM sizes, total), "
        "ranked AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS place, "
        "test - sum(floor(x)) OVER () AS extra FROM exact), "
        "given AS (SELECT label, n, CAST(floor(x) + (place <= extra)::INTEGER AS BIGINT) AS t "
        "FROM ranked)"
    )


@query(
    f"WITH {_PEOPLE_SQL}, {_allotment_sql('people', 'label')} "
    "SELECT label, t AS test, n - t AS train FROM given"
)
def feature_split(spark, sf):
    prepared = prepared_customers(spark, sf)
    rows = prepared.train.withColumn("part", F.lit(0)).select("label", "part").unionByName(
        prepared.test.withColumn("part", F.lit(1)).select("label", "part")
    )
    return rows.groupBy("label").agg(
        F.sum("part").cast("bigint").alias("test"),
        F.sum(1 - F.col("part")).cast("bigint").alias("train"),
    )


@query(
    f"WITH {_PEOPLE_SQL}, {_allotment_sql('people', 'label')} "
    "SELECT label, t AS n, TRUE AS guessed FROM given WHERE t > 0"
)
def license_confusion(spark, sf):
    """The final model's guesses on the test rows add up to them, label by label."""
    model = fit_license_model(prepared_customers(spark, sf))
    return model.predictions.groupBy("label").agg(
        F.count("*").alias("n"), F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("guessed")
    )


def _vectors(spark, sf):
    """Scaled feature vectors with key and label, and the feature names."""
    customers = with_label(feature_table(spark, sf), "promo")
    coded = one_hot(customers, "c_mktsegment", drop_first=True)
    names = [c for c in coded.columns if c not in ("c_custkey", "label")]
    filled = held(mean_filled(coded, names))
    rows = scaled(filled, scaling(filled, names)).withColumns(
        {"key": F.col("c_custkey")}
    )
    return as_vectors(rows, names, keep=["key", "label"]), names


def _imputed(spark, sf):
    """All customers with every unknown number predicted, and the columns that had any."""
    customers = with_label(feature_table(spark, sf), "promo")
    coded = one_hot(customers, "c_mktsegment", drop_first=True)
    names = [c for c in coded.columns if c not in ("c_custkey", "label")]
    targets = [c for c in _PLAIN_FEATURES if c != "c_nationkey"]
    coded = held(coded.withColumns({f"was_{c}": F.col(c) for c in targets}))
    train, test = split_rows(coded, "label", "c_custkey")
    train, test = predict_missing(train, test, targets, names)
    return train.unionByName(test), targets


@query()
def predictive_imputation(spark, sf):
    filled, targets = _imputed(spark, sf)
    return filled.select("c_custkey", *[F.round(c, 4).alias(c) for c in targets])


@query(
    f"WITH {S.LICENSES_SQL}, sizes AS (SELECT count(*) FILTER (license = 'PROMO') AS few, "
    "count(*) AS n FROM customer LEFT JOIN licenses USING (c_custkey)) "
    "SELECT label, greatest(few, n - few) AS n FROM sizes, (VALUES (0), (1)) AS v(label)"
)
def over_sampled_classes(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows, _ = _vectors(spark, sf)
    rows = rows.select("key", "label", vector_to_array("features").alias("vector"))
    balanced = over_sample(rows, "key", "vector", "label")
    return balanced.groupBy("label").agg(F.count("*").alias("n"))


@query()
def feature_impact(spark, sf):
    rows, names = _vectors(spark, sf)
    data = with_folds(rows, "label", "key")
    return model_search.drop_one_impact(data, names)


@query()
def logistic_search(spark, sf):
    rows, _ = _vectors(spark, sf)
    data = with_folds(rows, "label", "key")
    return model_search.search_logistic(data)


@query()
def neighbor_search(spark, sf):
    rows, _ = _vectors(spark, sf)
    return model_search.search_neighbors(with_folds(rows, "label", "key"))


@query()
def revenue_models(spark, sf):
    rows = feature_table(spark, sf).join(
        S.customer_licenses(spark, sf).select("c_custkey", "revenue"), "c_custkey"
    )
    names = _PLAIN_FEATURES
    filled = held(mean_filled(rows.select("c_custkey", "revenue", *names), names))
    train, test = split_rows(filled, "c_nationkey", "c_custkey")

    def vectors(part):
        part = part.withColumns({"key": F.col("c_custkey"), "label": F.col("revenue")})
        return as_vectors(part, names, keep=["key", "label"])

    return compare_revenue_models(vectors(train), vectors(test))


@query()
def license_model(spark, sf):
    return fit_license_model(prepared_customers(spark, sf)).coefficients


# --- what the models leave behind, checked -----------------------------------------------

_SEGMENT_FEATURES_SQL = (
    "SELECT DISTINCT 'c_mktsegment_' || c_mktsegment AS feature FROM customer "
    "WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM customer)"
)
_PLAIN_FEATURES = [
    "c_nationkey", "balance", "n_orders", "mean_price", "n_click", "n_error", "n_purchase",
    "n_signup", "n_view", "mean_hours",
]


@query(
    f"WITH names AS ({_SEGMENT_FEATURES_SQL} "
    + "".join(f"UNION ALL SELECT '{c}' " for c in _PLAIN_FEATURES)
    + ") SELECT feature, 0.0::DOUBLE AS slope FROM names WHERE (SELECT count(*) FROM customer) > 0"
)
def logistic_slopes(spark, sf):
    """The penalised loss is flat at the joint fit's weights, in the direction of each feature."""
    vectors, names = _vectors(spark, sf)
    rows = held(model_rows(vectors))
    weights = fit_many(rows, [Fit(tuple(range(len(names))), model_search.FINAL_C)])[0]
    cells = [F.col("x")[i] for i in range(len(names))]
    margin = sum((c * F.lit(float(w)) for c, w in zip(cells, weights)), F.lit(float(weights[-1])))
    miss = 1 / (1 + F.exp(-margin)) - F.col("label")
    sums = rows.agg(*[F.sum(miss * c).alias(f"s{i}") for i, c in enumerate(cells)])
    slopes = [
        F.struct(
            F.lit(n).alias("feature"),
            (F.round(F.col(f"s{i}") + float(weights[i]) / model_search.FINAL_C, 3) + 0.0).alias("slope"),
        )
        for i, n in enumerate(names)
    ]
    return sums.select(F.explode(F.array(*slopes)).alias("s")).select("s.*")


def _grid_sql(kind: str, settings: list[str]) -> str:
    values = ", ".join(f"('{x}')" for x in settings)
    return (
        f"SELECT '{kind}' AS classifier, settings, n AS rows, TRUE AS scored "
        f"FROM (VALUES {values}) AS v(settings), (SELECT count(*) AS n FROM customer)"
    )


def _checked(ranking):
    scored = F.col("mean_f1").between(0.0, 1.0)
    return ranking.select("classifier", "settings", "rows", scored.alias("scored"))


@query(_grid_sql("logistic", [f"C={float(c)}, penalty=l2" for c in range(5, 25, 2)]))
def logistic_grid(spark, sf):
    rows, _ = _vectors(spark, sf)
    return _checked(model_search.search_logistic(with_folds(rows, "label", "key")))


@query(_grid_sql("neighbors", [f"n_neighbors={k}" for k in range(2, 20, 2)]))
def neighbor_grid(spark, sf):
    rows, _ = _vectors(spark, sf)
    return _checked(model_search.search_neighbors(with_folds(rows, "label", "key")))


_OTHER_KINDS = (
    "decision_tree", "linear_svm", "hinge_linear", "random_forest", "bagging", "ada_boost",
)


_MARGIN_KINDS = ("linear_svm", "hinge_linear")


def _some_recipes() -> list:
    """The first setting of each other classifier's grid."""
    return [model_search.grid(kind)[0] for kind in _OTHER_KINDS]


@query(
    " UNION ALL ".join(
        _grid_sql(kind, [str(r) for r in _some_recipes() if r.kind == kind])
        for kind in dict.fromkeys(r.kind for r in _some_recipes())
    )
)
def classifier_grid(spark, sf):
    """A setting of every other classifier over two folds of all customers."""
    rows, _ = _vectors(spark, sf)
    data = with_folds(rows, "label", "key", folds=2)
    return _checked(model_search.search(data, _some_recipes()))


def _whole_grid(kind: str) -> None:
    """Registers ``<kind>_search``, every setting of the grid over five folds, and
    ``<kind>_refit``, the best one fitted on all rows with the weight of each feature.
    For kinds whose trees grow together, ``<kind>_grid`` is the first, checked: every setting is
    scored over all rows."""

    def found(spark, sf):
        rows, names = _vectors(spark, sf)
        data = with_folds(rows, "label", "key")
        return data, names, model_search.search(data, model_search.grid(kind))

    def searched(spark, sf):
        return found(spark, sf)[2]

    def refit(spark, sf):
        data, names, ranking = found(spark, sf)
        # The search let go of the rows; every pass of the last fit reads them all.
        data = held(data)
        try:
            recipe, model = model_search.refitted(data, ranking, model_search.grid(kind))
            weights = model_search.feature_weights(model, len(names))
        finally:
            data.unpersist()
        rows = [(recipe.kind, str(recipe), n, w) for n, w in zip(names, weights)]
        kinds = "classifier string, settings string, feature string, weight double"
        return spark.createDataFrame(rows, kinds)

    def checked(spark, sf):
        return _checked(searched(spark, sf))

    searched.__name__, refit.__name__ = f"{kind}_search", f"{kind}_refit"
    checked.__name__ = f"{kind}_grid"
    query()(searched)
    query()(refit)
    if model_search.grid(kind)[0].forest:
        query(_grid_sql(kind, [str(r) for r in model_search.grid(kind)]))(checked)


for _kind in _OTHER_KINDS:
    if _kind not in _MARGIN_KINDS:
        _whole_grid(_kind)


def _margin_grid(kind: str) -> None:
    """Registers ``<kind>_search`` and ``<kind>_refit`` as above, from one joint fit, and
    ``<kind>_grid``: no fit of the whole grid is further from the best weights there are than the
    bound."""

    def found(spark, sf):
        rows, names = _vectors(spark, sf)
        return names, *model_search.search_margins(with_folds(rows, "label", "key"), kind)

    def searched(spark, sf):
        return found(spark, sf)[1]

    def refit(spark, sf):
        names, ranking, models = found(spark, sf)
        best = ranking.where("place = 1").first().settings
        rows = [(kind, best, n, w) for n, w in zip(names, models[best].coefficients)]
        kinds = "classifier string, settings string, feature string, weight double"
        return spark.createDataFrame(rows, kinds)

    def checked(spark, sf):
        near = F.col("gap").between(-1e-9, GAP) & F.col("mean_f1").between(0.0, 1.0)
        return searched(spark, sf).select("classifier", "settings", "rows", near.alias("scored"))

    searched.__name__, refit.__name__ = f"{kind}_search", f"{kind}_refit"
    checked.__name__ = f"{kind}_grid"
    query()(searched)
    query()(refit)
    query(_grid_sql(kind, [str(r) for r in model_search.grid(kind)]))(checked)


for _kind in _MARGIN_KINDS:
    _margin_grid(_kind)


@query(
    f"WITH {S.LICENSES_SQL}, bought AS (SELECT c_nationkey FROM customer "
    f"JOIN licenses USING (c_custkey)), {_allotment_sql('bought', 'c_nationkey')}, "
    "test AS (SELECT CAST(sum(t) AS BIGINT) AS n FROM given) "
    "SELECT model, n AS rows, TRUE AS scored FROM test, (VALUES ('elastic_net'), "
    "('decision_tree'), ('random_forest'), ('neighbors')) AS v(model)"
)
def revenue_model_rows(spark, sf):
    found = revenue_models(spark, sf)
    scored = (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)
    return found.select("model", "rows", scored.alias("scored"))


@query(
    f"WITH {S.LICENSES_SQL}, tallies AS (SELECT user_id, "
    + ", ".join(
        f"count(*) FILTER (event_type = '{k}') AS n_{k}"
        for k in ("click", "error", "purchase", "signup", "view")
    )
    + ", avg(value) AS mean_hours FROM events GROUP BY 1), bought AS (SELECT o_custkey, "
    "count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1) "
    "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance, "
    "CAST(n_orders AS DOUBLE) AS n_orders, round(mean_price, 6) AS mean_price, "
    + ", ".join(
        f"CAST(n_{k} AS DOUBLE) AS n_{k}" for k in ("click", "error", "purchase", "signup", "view")
    )
    + ", round(mean_hours, 6) AS mean_hours, CAST(0 AS BIGINT) AS unknown FROM customer "
    "LEFT JOIN bought ON c_custkey = o_custkey LEFT JOIN tallies ON c_custkey = user_id"
)
def imputation_known_cells(spark, sf):
    """Cells that were known are unchanged, and none is unknown after the imputation."""
    filled, targets = _imputed(spark, sf)
    unknown = sum((F.col(c).isNull().cast("bigint") for c in targets), F.lit(0).cast("bigint"))
    known = [
        F.round(F.when(F.col(f"was_{c}").isNotNull(), F.col(c).cast("double")), 6).alias(c)
        for c in targets
    ]
    return filled.select("c_custkey", *known, unknown.alias("unknown"))
