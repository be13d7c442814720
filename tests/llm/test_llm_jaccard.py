import itertools
import random
import re

import numpy as np
import pytest

from custvalue.llm import jaccard as J
from custvalue.llm.components import components


def shingles(text, words):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows, words, threshold=80):
    sets = [shingles(text, words) for _, text in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
            label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def near_copies(seed, n, base_words, edits):
    rng = random.Random(seed)
    base = [f"b{seed}_{i}" for i in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            rng.choice([w.pop, lambda a: w.insert(a, f"i{rng.random()}"),
                        lambda a: w.__setitem__(a, f"s{rng.random()}")])(at)
            w = w or ["x"]
        out.append(" ".join(w))
    return out


def corpus():
    texts = [None, "", "one", "One", "one two", "a b c d", "a b c d e", "A B C D E f"]
    for seed, size in enumerate((5, 6, 7, 8, 9, 12, 15, 20, 30, 60, 200)):
        texts += near_copies(seed, 12, size, max(1, size // 12))
    texts += near_copies(50, 70, 80, 5)  # one large family, crowded throughout
    line = " ".join(f"common{i}" for i in range(30))
    texts += [line + " " + " ".join(f"own{i}_{k}" for k in range(25)) for i in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize(
    "threshold, members, paired, block", [(80, 32, 64, 1500), (80, 4, 6, 25), (60, 8, 3, 40)]
)
def test_components_equal_brute_force(spark, word_list, threshold, members, paired, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = J.similar_groups(
        df, threshold=threshold, members=members, paired=paired, block=block
    ).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert len(found) == len(rows) and got == brute(rows, word_list, threshold)


def test_every_pair_that_links_shares_an_entry():
    """The pigeonhole itself: no sets that reach the threshold go without a common entry."""
    rng = np.random.default_rng(4)
    for threshold in (80, 60):
        scheme, checked = J.Scheme(threshold), 0
        for n in [*range(1, 40), 64, 100, 333]:
            for _ in range(12):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                y = x[rng.random(len(x)) > rng.uniform(0, 0.25)]
                extra = rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)
                y = np.unique(np.concatenate([y, extra]))
                common = len(np.intersect1d(x, y))
                if not len(y) or 100 * common < threshold * (len(x) + len(y) - common):
                    continue
                checked += 1
                flat, edges = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
                for share in (0, 0.5, 1):
                    every = J.signatures(flat, edges, scheme, np.empty(0, np.uint64), all_=True)[1]
                    crowded = np.unique(rng.permutation(every)[: int(len(every) * share)])
                    who, entry, _ = J.signatures(flat, edges, scheme, crowded)
                    assert set(entry[who == 0].tolist()) & set(entry[who == 1].tolist()), n
                a, b = J.sketches(flat, edges)
                assert J.least_difference(a, b) <= len(x) + len(y) - 2 * common
        assert checked > 150


def test_hard_rows(spark, hard_documents):
    rows = J.similar_groups(hard_documents).collect()
    assert len(rows) == hard_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].component_id == 2 and by_id[2].n_shingles == 0
    assert by_id[6].component_id == 5 and by_id[8].component_id == 1
    assert by_id[None].component_id is None and by_id[None].n_shingles == 4
    assert J.similar_groups(hard_documents.limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    links += [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3), (300, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(101, 130))
    assert {found[i] for i in (200, 201, 202, 300)} == {200}
    assert components(df.limit(0)).collect() == []
