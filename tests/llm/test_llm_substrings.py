import random

from custvalue.llm import substrings as S


def brute(rows, window):
    def key(doc):
        return -(2**63) if doc is None else doc

    first, out = {}, []
    texts = [(doc, (text or "").split()) for doc, text in rows]
    for doc, w in texts:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            first[run] = min(first.get(run, (2**70, 0)), (key(doc), i))
    for doc, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key(doc), i):
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def made(seed, ids):
    rng = random.Random(seed)
    pool = [[rng.choice("abcd") for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(100):
        w = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                w += rng.choice(pool)[rng.randint(0, 10) : rng.randint(10, 30)]
            else:
                w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        doc = i if ids == "unique" else rng.choice([None, *range(70)])
        rows.append((doc, " ".join(w) if rng.random() > 0.05 else None))
    return rows


def test_removed_words_equal_brute_force(spark):
    for seed, ids in ((1, "unique"), (2, "repeated")):
        rows = made(seed, ids)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = S.without_repeats(df, window=6, group_bytes=200)
        found = sorted(
            [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=repr
        )
        assert found == brute(rows, 6)


def test_spans_are_maximal(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, "x " + text + " y"), (3, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.without_repeats(df, spans=True).collect()}
    assert got[1].removed_spans == []
    assert [tuple(s) for s in got[2].removed_spans] == [(1, 51)]
    assert got[2].kept_text == "x y" and got[3].kept_text == ""


def test_crowded_prefixes_only_steer(spark):
    # One prefix that every text shares, before different continuations.
    rows = [(i, "p q r s " + " ".join(f"w{i}_{j}" for j in range(30))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.without_repeats(df, window=20, group_bytes=500)
    found = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=repr)
    assert found == brute(rows, 20)
    crowded = S.crowded_prefixes(
        df.selectExpr("doc_id AS id", "xxhash64(text) AS key", "text"), 10_000, 20, 500
    )
    assert len(crowded[1]) >= 1


def test_hard_rows(spark, hard_documents):
    rows = S.without_repeats(hard_documents)
    assert rows.columns[-3:] == ["n_words", "n_removed", "kept_text"]
    got = {r.doc_id: r for r in rows.collect()}
    assert got[2].n_words == 0 and got[2].kept_text == ""
    assert got[5].n_removed < got[5].n_words and got[6].n_removed == got[6].n_words
    assert S.without_repeats(hard_documents.limit(0)).count() == 0
    assert S.without_repeats(hard_documents.where("text IS NULL")).count() == 1
