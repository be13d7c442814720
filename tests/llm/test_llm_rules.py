import random
import re

from pyspark.sql import functions as F

from custvalue.llm import rules as R


def brute(text, words):
    text = text or ""
    w, runs, seen, dup, lines = words(text), {}, set(), 0, 0
    for i in range(len(w) - 4):
        runs.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for places in runs.values() if len(places) > 1 for i in places for k in range(5)}
    for line in text.split("\n"):
        if words(line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(again), lines


def test_measures_equal_brute_force(spark, word_list):
    random.seed(5)
    vocabulary = ["a", "bb", "ü", "#c", "x|y", "\n", "\n", "\r", "Z"]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "\n\n", "a b c d e " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in R.ledger(df).collect()}
    for i, text in enumerate(texts):
        assert tuple(found[i])[1:7] == brute(text, word_list), text


def test_hard_rows_are_judged(spark, hard_documents):
    entries = R.ledger(hard_documents)
    rows = entries.withColumn("kept", R.kept(R.CURRENT)).collect()
    assert len(rows) == hard_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0
    assert not by_id[2].kept and by_id[5].n_words == 80_000
    assert R.ledger(hard_documents.limit(0)).collect() == []
    assert R.ablations(entries.limit(0), [R.BASE]).collect() == []


def test_ablations_count_what_each_rule_does_alone(spark):
    data = [(0b000,), (0b001,), (0b001,), (0b011,), (0b100,)]
    entries = spark.createDataFrame(data, "failed long")
    rows = {(r.policy, r.rule): r for r in R.ablations(entries, [R.BASE, R.CURRENT]).collect()}
    few = rows["base", "few_words"]
    assert (few.documents, few.failing, few.dropped_by_it_alone) == (5, 3, 2)
    assert rows["2", "symbols"].dropped_by_it_alone == 1
    kept = entries.where(R.kept(R.BASE)).agg(F.count("*")).first()[0]
    assert kept == 2
