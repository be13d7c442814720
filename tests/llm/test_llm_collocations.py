import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custvalue.llm import collocations as C

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs, least, first=2000, most=5):
    counts, totals, out = {}, Counter(), set()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, most + 1):
                for p in range(len(words) - size + 1):
                    phrase = tuple(words[p : p + size])
                    counts.setdefault(lang, Counter())[phrase] += 1
    for lang, every in counts.items():
        f = {p: c for p, c in every.items() if c >= least}
        scored = []
        for phrase, a in f.items():
            if len(phrase) < 2:
                continue
            cuts = []
            for k in range(1, len(phrase)):
                left, right = f[phrase[:k]], f[phrase[k:]]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            longer = (
                q for q in f if len(q) > len(phrase) and f[q] >= a
                and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
            )
            if not any(longer):
                scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def result(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, n=120):
    random.seed(seed)
    words = ["a", "B", "b", "ü", "of", "the", "the", "x-y", "É", "é", " "]
    ends = [" ", " ", "  ", "\t", " ", ". ", ",", "\n", " ! ", "\x0b"]
    fixed = ["the of a b", "in spite of the", "x-y x-y x-y x-y x-y x-y"]
    docs = []
    for _ in range(n):
        parts = [random.choice([random.choice(words), random.choice(fixed)]) for _ in range(40)]
        text = "".join(p + random.choice(ends) for p in parts)
        docs.append((random.choice(["en", "en", "fr", None, "und"]), text))
    return docs


@pytest.mark.parametrize("broadcast_rows", [1 << 18, 0, 15])
def test_phrases_equal_brute_force(spark, broadcast_rows):
    docs = made_up(2)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    found = C.collocations(df, least=6, broadcast_rows=broadcast_rows)
    want = brute(docs, 6)
    assert result(found) == want
    assert {len(row[2].split(" ")) for row in want} >= {2, 3, 4, 5}


def test_first_rows_are_found_in_parts(spark, monkeypatch):
    docs = made_up(5)
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(C, "_RANKED_TOGETHER", 7)
    assert result(C.collocations(df, least=4, first=5)) == brute(docs, 4, first=5)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [
        (10**15 + 7, [10**15 + 9, 10**16 + 1], [10**15 + 9, 10**16 + 3], 9 * 10**16),
        (2**57, [2**57, 2**57], [2**57, 2**57 + 1], 2**57 + 5),
        (100, [100, 100], [100, 100], 10**13),
    ]
    df = spark.createDataFrame(rows, "f long, heads array<long>, tails array<long>, n long")
    for row in df.withColumn("cut", C._score(3)).collect():
        cuts = [(1000 * row.f * row.n // (row.heads[k - 1] * row.tails[2 - k]), k) for k in (1, 2)]
        assert (row.cut.score, row.cut.k) == min(cuts)


def test_pieces_and_documents_are_borders(spark):
    docs = [("en", "a b. a\nb"), ("en", "b"), ("en", "a"), ("en", "b\ta ;b")]
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert result(C.collocations(df, least=1)) == brute(docs, 1)


def test_hard_rows(spark, hard_documents):
    clash = hard_documents.withColumnsRenamed({"n_words": "words", "n_chars": "item"})
    clash = clash.withColumn("block", F.lit("x"))
    docs = [(r.lang, r.text) for r in hard_documents.collect()]
    assert result(C.collocations(clash, least=3)) == brute(docs, 3)
    short = [d for d in docs if len(d[1] or "") < 1000]
    assert result(C.collocations(clash.where("item IS NULL OR item < 1000"), least=2)) == brute(short, 2)
    assert C.collocations(clash.limit(0)).collect() == []
    assert C.collocations(clash.where("text IS NULL")).collect() == []


def test_a_long_piece_without_marks(spark):
    docs = [("en", "tick tock " * 60_000), ("en", None), ("en", "")]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert result(C.collocations(df)) == brute(docs, 100)


@pytest.mark.parametrize("held", [1 << 21, 500])
@pytest.mark.parametrize("parts", [1, 7, 5000])
def test_counts_leave_a_task_in_few_bytes(monkeypatch, held, parts):
    monkeypatch.setattr(C, "_HELD_PAIRS", held)
    random.seed(1)
    want, batches = Counter(), []
    for _ in range(5):
        items = [int(random.paretovariate(0.4)) % 1000 for _ in range(4000)]
        want.update(zip(items, items[1:]))
        block = C._packed(0, np.arange(4000), np.array(items))
        assert len(block["item"]) == 2 * 4000
        assert C._unpacked(block["step"], block["item"])[1].tolist() == items
        columns = [pa.array([block[name]], pa.binary()) for name in ("step", "item")]
        batches.append(pa.RecordBatch.from_arrays(columns, ["step", "item"]))
    codes, found, size = C._PairCodes(1000, parts), Counter(), 0
    for batch in C._pair_counts(codes)(iter(batches)):
        for row in batch.to_pylist():
            step, n = (C._from_bytewise(row[name], row["size"]) for name in ("step", "n"))
            x, y = codes.pairs(row["part"], np.cumsum(step))
            found.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
            size += len(row["step"]) + len(row["n"])
    assert found == want
    assert size <= 8 * (len(want) if held > 500 else 20_000)


def test_pairs_dealt_to_many_groups(spark, monkeypatch):
    docs = made_up(7)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    monkeypatch.setattr(C, "_ADDED_TOGETHER", 50)
    monkeypatch.setattr(C, "_COUNTED_TOGETHER", 1000)
    assert result(C.collocations(df, least=6)) == brute(docs, 6)


def test_numbers_have_no_gaps(spark):
    rows = C._numbered(spark.range(1000).repartition(7).select(F.col("id").alias("f")))
    assert sorted(r.id for r in rows.collect()) == list(range(1000))


def test_many_frequent_groups_go_in_lists_without_a_join(spark, monkeypatch):
    def join(*_):
        raise AssertionError("a join sends every pair of every block")

    docs = made_up(2)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    monkeypatch.setattr(C, "_by_block", join)
    assert result(C.collocations(df, least=6, broadcast_rows=15)) == brute(docs, 6)
    assert [C._lists(n, 15) for n in (0, 15, 16, 15 * 64, 15 * 64 + 1)] == [1, 1, 2, 64, 0]
    assert C._lists(5, 0) == 0


def test_a_task_holds_one_list_at_a_time(spark):
    for number in (1, 3):
        sent = C._Sent(spark, iter([np.arange(k, k + 3) for k in range(number)]))
        for _ in range(2):
            for k, one in enumerate(sent):
                assert one.tolist() == [k, k + 1, k + 2]
                held = sum("_value" in vars(each) for each in sent.lists)
                assert held == 1
