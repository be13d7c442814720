import random
import re
import zlib
from collections import Counter

import pytest

from custvalue.llm import spellings as S

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counts_of(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += len(run) >= 7
    return {word: n for word, n in found.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups_of(counts):
    around = {a: [b for b in counts if near(a, b)] for a in counts}
    form = {}
    for word, others in around.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 10 * counts[word]:
            form[word] = best
    rows = set()
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, len(around[word]), counts.get(form.get(word))))
    return rows


def result(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up_texts(seed, n=60):
    random.seed(seed)
    stems = ["".join(random.choices("abéÿ", k=random.randint(6, 9))) for _ in range(40)]
    marks = [" ", ", ", "\n", "9", "ŏ", "_", "Ā"]

    def word():
        letters = list(random.choice(stems[: random.randint(1, 40)]))
        for _ in range(random.choice([0, 0, 0, 1, 2])):
            letters[random.randrange(len(letters))] = random.choice("abAé×ÿcß")
        return "".join(letters)

    return [
        (i, "".join(word() + random.choice(marks) for _ in range(random.randint(0, 120))))
        for i in range(n)
    ]


@pytest.mark.parametrize("settings", [{}, {"symbols": 2, "crowded": 1}, {"symbols": 1, "crowded": 5}])
def test_groups_equal_brute_force(spark, settings):
    docs = made_up_texts(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    counts = S.counted(S.noisy_words(df))
    want = counts_of(docs)
    assert {r.word: r.n for r in counts.collect()} == want
    found = result(S.variant_groups(counts, **settings))
    assert found == groups_of(want)
    assert any(row[1] for row in found) and max(row[4] for row in found) > 3


def test_long_words_and_words_on_the_border_find_each_other(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=41))
    words = {base[:39]: 2, base[:40]: 3, base[:41]: 2, base[:39] + "z": 40, base: 2}
    words["y" + base] = 7
    huge = "ab" * 100_000
    words |= {huge: 2, huge + "a": 50, huge[:-1] + "c": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r.word: r for r in S.variant_groups(df).collect()}
    for word in words:
        others = [o for o in words if o != word and abs(len(o) - len(word)) < 2]
        if len(word) < 100:
            assert rows[word].n_near == sum(near(word, o) for o in others), word
    assert rows[huge].form == rows[huge].root == huge + "a" and rows[huge].n_near == 2


def test_chains_are_followed_to_the_end(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    rows = [(w, 2 * 10**k) for k, w in enumerate(chain)]
    df = spark.createDataFrame(rows, "word string, n long")
    found = {r.word: r for r in S.variant_groups(df).collect()}
    assert {r.root for r in found.values()} == {chain[-1]}
    assert [found[w].form for w in chain] == chain[1:] + [None]


def test_ties_go_to_the_smaller_word(spark):
    rows = [("mmmmmmm", 2), ("mmmmmmz", 20), ("mmmmmma", 20), ("mmmmmmÿ", 20)]
    df = spark.createDataFrame(rows, "word string, n long")
    found = {r.word: r for r in S.variant_groups(df).collect()}
    assert found["mmmmmmm"].form == "mmmmmma" and found["mmmmmmm"].n_near == 3


def test_hard_rows(spark, hard_documents):
    docs = [(r.doc_id, r.text) for r in hard_documents.collect()]
    assert result(S.variants_of(hard_documents)) == groups_of(counts_of(docs))
    assert S.variants_of(hard_documents.limit(0)).collect() == []


def test_a_larger_vocabulary_takes_more_symbols():
    assert S.symbols_for(0) == S.symbols_for(2**19) == S.SYMBOLS
    assert S.symbols_for(2**23) == 2 * S.SYMBOLS
