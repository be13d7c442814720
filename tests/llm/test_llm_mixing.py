import numpy as np
import pytest
from pyspark.sql import functions as F

from custvalue.llm import mixing as M


def test_targets_stop_and_the_excess_is_shared_again():
    assert M.share_out([10, 10, 10], [3, 1, 2], 45) == [20.0, 25 / 3, 50 / 3]
    assert M.share_out([0, 10], [1, 1], 15) == [0.0, 15.0]
    assert M.share_out([], [], 0) == []
    assert M.share_out([10], [1], 100) == [20.0]


def corpus(spark):
    rows = [
        (i, " ".join(f"{i}w{k}" for k in range(i % 40)), ["hot", "b", "c", None][max(0, i % 9 - 5)])
        for i in range(900)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_sources_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "_SLICE_ROWS", 50)
    monkeypatch.setattr(M, "_SLICES_PER_BLOCK", 4)
    docs = corpus(spark)
    plan = M.schedule(docs).join(docs.withColumnRenamed("doc_id", "id"), "id").cache()
    by_source = plan.groupBy("source").agg(
        F.sum("words").alias("taken"), F.first("target").alias("target"),
        F.first("source_size").alias("size"),
    ).collect()
    assert {r.source for r in by_source} == {"hot", "b", "c", None}
    for r in by_source:
        assert abs(r.taken - r.target) <= 1 and r.target <= 2 * r.size
    total = sum(r["size"] for r in by_source)
    assert abs(sum(r.target for r in by_source) - min(1.5 * total, 2 * total)) < 1e-6
    per_doc = plan.groupBy("id").agg(F.sum("words").alias("t"), F.first("size").alias("s"))
    assert per_doc.where("t > 2 * s").count() == 0 and per_doc.count() == 900
    # Positions are the running total in order of virtual finish.
    ordered = plan.where("words > 0").orderBy("position").collect()
    assert [r.position for r in ordered] == [
        sum(x.words for x in ordered[:i]) for i in range(len(ordered))
    ]
    finish = [r.virtual_finish for r in ordered]
    assert finish == sorted(finish) and finish[-1] <= 1


def test_reruns_agree_whatever_the_layout(spark):
    docs = corpus(spark)
    one, two = (
        {(r.id, r.copy): r.words for r in M.schedule(d).collect()}
        for d in (docs, docs.repartition(2))
    )
    assert one == two


def test_mixed_rows_have_their_texts(spark, word_list):
    docs = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = M.mix(docs).collect()
    assert sum(len(word_list(r.text)) for r in rows) == sum(r.mix_words for r in rows)
    for r in rows:
        assert word_list(texts[r.doc_id])[: r.mix_words] == word_list(r.text)
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)


def test_hard_rows(spark, hard_documents, word_list):
    plan = M.schedule(hard_documents)
    assert plan.where("copy = 0").count() == hard_documents.count()
    totals = plan.groupBy("target").agg(F.sum("words").alias("t")).collect()
    assert all(r.t <= r.target + 1 for r in totals)
    mixed = M.mix(hard_documents)
    assert mixed.columns == [*hard_documents.columns, "copy", "mix_words", "mix_position"]
    assert mixed.count() > 0
    assert M.schedule(hard_documents.limit(0)).collect() == []
    assert M.mix(hard_documents.where("text IS NULL")).collect() == []


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="more than 2 sources"):
        M.schedule(corpus(spark))


def given_by(copies, t):
    return sum(min(max(w * t - b, 0), s) for b, s, w in copies if w > 0)


@pytest.mark.parametrize("seed", range(4))
def test_the_end_is_when_the_budget_is_given(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "_TIME_SLICES", 3)
    random = np.random.default_rng(seed)
    copies = []
    for weight in (3.0, 1.0, 2.0, 0.0, 0.7):
        begin = 0
        for size in random.integers(0, 200, 15) ** 2 // 100:
            copies.append((begin, int(size), weight))
            begin += int(size)
    df = spark.createDataFrame(copies, "begin long, size long, weight double").repartition(3)
    total = given_by(copies, 1e9)
    for share in (0.01, 0.4, 0.9, 0.999):
        end = M.end_of_mix(df, share * total)
        assert abs(given_by(copies, end) - share * total) < 1e-6 * total
    assert M.end_of_mix(df, total + 1) is None
    assert M.end_of_mix(df.limit(0), 5) is None


def test_times_and_not_targets_decide_what_is_taken(spark, monkeypatch):
    docs = corpus(spark)

    def taken():
        return {(r.id, r.copy): r.words for r in M.schedule(docs).where("words > 0").collect()}

    before = taken()
    monkeypatch.setattr(M, "share_out", lambda sizes, *_: [0.0] * len(sizes))
    assert taken() == before
    # At any other time each source has given its weight times that, up to two rounds.
    monkeypatch.setattr(M, "end_of_mix", lambda copies, budget: 1500.0)
    sizes = {r.source: r.size for r in docs.groupBy("source").agg(
        F.sum(M.n_words(F.col("text"))).alias("size")
    ).collect()}
    plan = M.schedule(docs).join(docs.withColumnRenamed("doc_id", "id"), "id")
    found = {r.source: r.n for r in plan.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    weights = {"b": 3, "c": 1, "hot": 2, None: 3}
    assert found == {s: min(weights[s] * 1500, 2 * sizes[s]) for s in sizes}


def test_a_budget_beyond_all_rounds_takes_everything_twice(spark):
    plan = M.schedule(corpus(spark), budget_share=9.0)
    assert plan.where("words <> size").count() == 0 and plan.where("size > 0 AND copy = 1").count()
