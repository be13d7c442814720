import collections
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from custvalue.llm import stages
from custvalue.llm.shared import saved

FOLDER = "/root/testdata/sf0.001"


def test_the_eleven_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], FOLDER)))
    return out


def test_stages_keep_the_columns_and_take_effect(steps):
    docs = steps[0]
    for step in steps[1:-1]:
        assert step.schema.names == docs.schema.names
    counts = [s.count() for s in steps]
    assert counts[1] < counts[0] and counts[2] < counts[1]


def test_one_document_of_each_group_stays(spark, steps, word_list):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    after = {r.doc_id for r in steps[2].collect()}
    sets = {}
    for doc, text in before.items():
        w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    label = {doc: doc for doc in sets}
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    assert after == {doc for doc in docs if label[doc] == doc}


def test_no_passage_is_left_twice(steps, word_list):
    before = {r.doc_id: word_list(r.text) for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    seen, expected = set(), {}
    for doc in sorted(before):
        w, gone = before[doc], set()
        for i in range(len(w) - 19):
            run = tuple(w[i : i + 20])
            if run in seen:
                gone |= set(range(i, i + 20))
            seen.add(run)
        expected[doc] = [x for i, x in enumerate(w) if i not in gone]
    expected = {doc: w for doc, w in expected.items() if w or not before[doc]}
    assert {doc: word_list(r.text) for doc, r in after.items()} == expected
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_sources_are_mixed_and_packed(steps, word_list):
    before, after = steps[3].collect(), steps[4].collect()
    size, taken = collections.Counter(), collections.Counter()
    for r in before:
        size[r.source] += len(word_list(r.text))
    for r in after:
        taken[r.source] += len(word_list(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] + 1 for s in size)
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in after}
    ends = collections.defaultdict(list)
    for r in pieces:
        ends[r.sequence_id].append((r.offset, r.length))
    for content in ends.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 4096


def test_run_equals_its_stages(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = corpus_pipeline.run(spark, FOLDER).select(*columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, steps[5].select(*columns).collect()))


def test_hard_rows_go_through_all_stages(spark, hard_documents):
    docs = hard_documents
    for empty in (False, True):
        step = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = saved(stage(spark, step, FOLDER))
            assert step.columns == docs.columns
        packed = corpus_pipeline.pack(spark, step, FOLDER)
        assert (packed.count() == 0) == empty
    one = stages.one_of_each_group(docs.where("doc_id = 8"))
    assert one.count() == 1
    assert stages.one_of_each_group(docs.where(F.col("doc_id").isNull())).count() == 1
