import pytest
from pyspark.sql import functions as F

from custvalue.bindings.registry import table
from custvalue.llm import langid as L
from custvalue.llm import subwords as S

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def parts(spark):
    docs = table(spark, FOLDER, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return docs.where(~held_out), docs.where(held_out)


@pytest.fixture(scope="module")
def model(parts):
    return L.fit(parts[0])


def test_held_out_documents_are_recognised(parts, model):
    found = L.predict(parts[1], model).join(parts[1].select("doc_id", "lang"), "doc_id").collect()
    right = [r.lang == r.lang_pred for r in found]
    assert sum(right) / len(right) > 0.97
    accepted = [r for r in found if r.accepted]
    assert len(accepted) > 0.8 * len(found)
    assert sum(r.lang == r.lang_pred for r in accepted) / len(accepted) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_a_refit_is_the_same(parts, model):
    again = L.fit(parts[0])
    assert (again.table == model.table).all() and again.limit == model.limit


def test_hard_rows(hard_documents, model):
    found = {r.doc_id: r for r in L.predict(hard_documents, model).collect()}
    for doc in (2, 3, 4, 9):
        assert (found[doc].lang_pred, found[doc].score, found[doc].accepted) == ("und", 0.0, False)
    assert found[1].lang_pred == found[8].lang_pred != "und"
    assert L.predict(hard_documents.limit(0), model).collect() == []


def test_without_a_language_to_learn_every_text_is_unknown(hard_documents):
    for nothing in (hard_documents.limit(0), hard_documents.where("lang IS NULL")):
        found = L.predict(hard_documents, L.fit(nothing)).collect()
        assert len(found) == hard_documents.count()
        assert {(r.lang_pred, r.score, r.accepted) for r in found} == {("und", 0.0, False)}


def test_one_language_is_enough(spark, hard_documents):
    only = L.fit(hard_documents.where("lang = 'de'"))
    found = L.predict(hard_documents, only).collect()
    assert {r.lang_pred for r in found} == {"de", "und"}


def test_subwords_know_texts_apart_and_see_all_of_them():
    texts = ["ab cd", None, "", "12", "ab cd" * 3]
    one = [S.bucket_counts(t, 12) for t in texts]
    assert len(one[1][0]) == len(one[2][0]) == len(one[3][0]) == 0
    dense = S.shares(texts, 12)
    for row, (bucket, share) in zip(dense, one):
        expected = 0 * row
        expected[bucket] = share
        assert abs(row - expected).max() < 1e-12
    long = "xy " * (S._PIECE // 2) + "qz"
    assert set(S.bucket_counts("qz", 12)[0][:1]) <= set(S.bucket_counts(long, 12)[0])
