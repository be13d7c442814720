import numpy as np
import pytest
from pyspark.sql import functions as F

from custvalue.bindings.registry import table
from custvalue.llm import cotraining as C

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    labels = table(spark, FOLDER, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    return table(spark, FOLDER, "documents"), labels


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    # Learn from half of the labels.
    return C.fit(docs, labels.where("doc_id % 2 = 0"))


def test_kept_out_labels_are_told_apart(tables, model):
    docs, labels = tables
    rows = C.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.bad == 0]
    bad = [r for r in rows if r.bad == 1]
    assert sum(not r.accepted for r in good) <= 0.02 * len(good)
    assert sum(not r.accepted for r in bad) >= 0.7 * len(bad)
    assert all(0 <= p <= 1 for r in rows for p in (r.p_text, r.p_metadata, r.score))


def test_each_view_sees_its_own_columns_only(tables, model):
    docs = tables[0].limit(50)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(5)})
    one = {r.doc_id: r for r in C.scored(docs, model).collect()}
    for r in C.scored(other, model).collect():
        assert r.p_text == one[r.doc_id].p_text
    for r in C.scored(docs.withColumn("text", F.lit("z")), model).collect():
        assert r.p_metadata == one[r.doc_id].p_metadata


def test_a_refit_is_the_same(tables, model):
    again = C.fit(tables[0], tables[1].where("doc_id % 2 = 0"))
    assert np.array_equal(again.text, model.text) and again.limit == model.limit


def test_hard_rows(hard_documents, tables, model):
    clash = hard_documents.withColumn("score", F.lit("mine"))
    rows = C.scored(clash, model)
    assert rows.columns == [*hard_documents.columns, "p_text", "p_metadata", "score", "accepted"]
    found = rows.collect()
    assert len(found) == hard_documents.count() and all(r.score is not None for r in found)
    assert C.scored(hard_documents.limit(0), model).collect() == []
    docs, labels = tables
    for few in (labels.limit(0), labels.where("bad = 0"), labels.where("bad = 1")):
        assert all(r.accepted for r in C.scored(hard_documents, C.fit(docs, few)).collect())
    assert C.fit(hard_documents.limit(0), labels).limit == 0.0


def test_pool_is_every_unlabelled_document(spark, tables):
    docs, labels = tables
    some = labels.where("doc_id % 2 = 0")
    rows = C._rows(docs, {"id": "doc_id", "text": "text"} | {c: c for c in C.METADATA})
    scratch = C.Scratch()
    pool = C._unlabelled(C._pool(rows, scratch), C._known(some, "doc_id", "bad"))
    assert pool.count() == docs.join(some, "doc_id", "left_anti").count()
    scratch.clear()


def test_rare_kinds_beyond_the_sample_teach(spark, tables, monkeypatch):
    """Of 12,000 unlabelled rows six are of a kind that no sample of the table would hold."""
    docs, labels = tables
    seen = []
    kept = C._looked_up

    def spy(pool, keys):
        found = kept(pool, keys)
        seen.extend(found)
        return found

    monkeypatch.setattr(C, "_looked_up", spy)
    ids = (F.col("id") + 10_000_000).alias("doc_id")
    junk = F.when(F.col("id") % 2000 == 7, F.lit("!!!! $$$$ BUY BUY BUY !!!! ")).otherwise("a b")
    many = spark.range(12_000).select(
        ids, F.repeat(junk, 40).alias("text"), F.lit("en").alias("lang"), F.lit("rare").alias("source"),
        F.lit(40).cast("long").alias("n_chars"),
    )
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    known = docs.join(labels, "doc_id", "left_semi").select(*columns)
    C.fit(known.unionByName(many), labels, rounds=2, confidence=0.5, sample=300)
    rare = [c for _, c, _ in seen if np.frombuffer(c, "<f4")[1 << C.BITS :][6] > 0.3]
    # Copies teach once, and no labelled document comes in again.
    assert len(rare) == 1 and len(seen) == 2


def test_limit_weighs_recall_against_loss_and_bears_wrong_labels():
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.uniform(0.6, 1, 850), rng.uniform(0, 0.3, 150)])
    good = np.repeat([1, 0], [850, 150])
    assert C.best_limit(p, good) == 0.5
    # Wrong labels: 1 % of the good rows score as junk does.
    p[:9] = 0.001
    limit = C.best_limit(p, good)
    assert 0.3 < limit <= 0.6 and (p[good == 0] < limit).mean() >= 0.95
    # Rejecting a fifth of the good rows is not worth half of the bad ones.
    p = np.concatenate([np.full(80, 0.9), np.full(20, 0.4), np.full(50, 0.4), np.full(50, 0.1)])
    assert 0.1 < C.best_limit(p, np.repeat([1, 0], [100, 100])) < 0.4


def test_recall_of_bad_documents(tables, model):
    docs, labels = tables
    rows = C.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad = [r for r in rows if r.bad == 1]
    good = [r for r in rows if r.bad == 0]
    recall = sum(not r.accepted for r in bad) / len(bad)
    lost = sum(not r.accepted for r in good) / len(good)
    print(f"recall {recall:.4f} of {len(bad)}, lost {lost:.4f} of {len(good)}, {model.limit}")
    assert recall - C.LOSS * lost >= 0.7


def test_rare_class_is_sampled_whole(spark, tables):
    docs, labels = tables
    rows = C._rows(docs, {"id": "doc_id", "text": "text"} | {c: c for c in C.METADATA})
    bad = labels.where("bad = 1").limit(12)
    some = labels.where("bad = 0").unionByName(bad).localCheckpoint()
    sample, total = C._sample(rows, C._known(some, "doc_id", "bad"), 60)
    assert total == {0: some.where("bad = 0").count(), 1: 12}
    assert sum(r[1] for r in sample) >= 12 and len(sample) < 120
