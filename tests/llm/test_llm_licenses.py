import random
import re

import numpy as np
import pytest

from custvalue.llm import licenses as L
from custvalue.llm import queries
from custvalue.llm.license_rules import BASE, CONFIDENCE, MENTION, NAMED, NOTICE, SIGNATURES, TAG, Rule

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def overlaps_resolved(found):
    """(start, end, priority, rule) that stay, by comparing each with each."""
    def beats(x, y):
        a, b = (x[1] - x[0], -x[3]), (y[1] - y[0], -y[3])
        return x[2] < y[2] or (x[2] == y[2] and a > b)

    def nested(x, y):
        return (x[0] <= y[0] and y[1] <= x[1]) or (y[0] <= x[0] and x[1] <= y[1])

    stay = []
    for one in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[3], d[0])):
        if not any(nested(one, other) and beats(other, one) for other in stay):
            stay.append(one)
    return stay


def brute(text, rules=SIGNATURES):
    words = words_of(text)
    line = " ".join(words)
    places = [
        (i, rule.label)
        for rule in rules if rule.base
        for n in [len(rule.keyword.split(" "))]
        for i in range(len(words) - n + 1)
        if words[i : i + n] == rule.keyword.split(" ")
    ]
    found = [
        (m.start(), m.end(), rule.priority, number)
        for number, rule in enumerate(rules)
        for m in re.finditer(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", line)
    ]
    stay = overlaps_resolved(found)
    labels = {rules[d[3]].label for d in stay} | {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)),
        max((CONFIDENCE[d[2]] for d in stay), default=0.0),
    )


EXAMPLES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "See https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later",
    "SPDX-License-Identifier: GPL-3.0-only": "gpl-3.0-only",
    "the Mozilla Public License 2.0": "mpl-2.0",
    "GNU Lesser General Public License v2.1 or later": "gpl,lgpl-2.1-or-later",
    "Copyright (c) 2020. All Rights Reserved.": "copyright,reserved",
    "Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3.0",
    "Tous droits réservés": "reserved",
    "a permit for gplants and submitted licenses, as easy": "",
}


def spelled(parts):
    """A random text that a parsed pattern matches."""
    out = ""
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            options = [v for k, v in value if str(k) in ("LITERAL", "RANGE")]
            if str(value[0][0]) == "NEGATE":
                out += random.choice("xyz")
            else:
                one = random.choice(options)
                out += chr(random.randint(*one) if isinstance(one, tuple) else one)
        elif name == "NOT_LITERAL":
            out += random.choice("xyz")
        elif name == "MAX_REPEAT":
            low, high, inner = value
            times = random.randint(low, min(high, low + 3))
            out += "".join(spelled(inner) for _ in range(times))
        elif name == "SUBPATTERN":
            out += spelled(value[-1])
        elif name == "BRANCH":
            out += spelled(random.choice(value[1]))
        else:
            raise AssertionError(name)
    return out


def test_every_match_holds_its_rules_keyword():
    random.seed(3)
    assert len(SIGNATURES) > 300 and len(set(SIGNATURES)) == len(SIGNATURES)
    scanner = L.Scanner(SIGNATURES)
    for number, rule in enumerate(SIGNATURES):
        for _ in range(20):
            text = spelled(re._parser.parse(rule.pattern))
            assert rule.keyword in text, (rule, text)
            assert words_of(text) == text.split(" "), (rule, text)
            assert scanner.rules[number][1].search(text.encode()), (rule, text)


@pytest.mark.parametrize("text", EXAMPLES)
def test_examples(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.scanned(df).first()
    assert row.labels == EXAMPLES[text]


def made_up(seed, n=250):
    random.seed(seed)
    pieces = list(EXAMPLES) + [
        "cc by", "CC-BY", "cc", "by", "General Public", "License", "license", "all rights", "reserved",
        "ALL RIGHTS RESERVED", "rights", "©", "2020", "é", "public domain", "gnu", "gpl", "or later",
        "version 2", "the", "\n", "İ", "\x00", "K", "licensed under the", "mit", "as is", "Ünder",
    ]
    return [
        "".join(random.choice(pieces) + random.choice([" ", ", ", "-", "\n", "  "])
                for _ in range(random.randint(0, 25)))
        for _ in range(n)
    ]


def test_scan_equals_brute_force(spark):
    texts = made_up(4) + [None, "", " .,\n", "cc by " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: tuple(r)[1:] for r in L.scanned(df).collect()}
    for i, text in enumerate(texts):
        assert rows[i] == brute(text), text
    assert len({row[5] for row in rows.values()}) > 30


def test_priority_and_containment_decide():
    def stay(*found):
        start, end, priority = np.array(found).T
        return L.resolved(start, end, priority).tolist()

    assert stay((0, 9, NAMED), (2, 5, NAMED)) == [True, False]
    assert stay((0, 9, MENTION), (2, 5, NAMED)) == [False, True]
    assert stay((0, 9, NAMED), (2, 5, TAG)) == [False, True]
    assert stay((0, 9, NOTICE), (2, 5, NAMED)) == [True, False]
    assert stay((0, 5, NOTICE), (3, 9, NAMED)) == [True, True]
    assert stay((0, 5, NAMED), (0, 5, NAMED)) == [True, False]
    random.seed(1)
    for _ in range(300):
        spans = [(a, a + random.randint(1, 6), random.randint(0, 2)) for a in
                 random.choices(range(12), k=random.randint(1, 9))]
        want = overlaps_resolved([(*s, i) for i, s in enumerate(spans)])
        assert np.flatnonzero(stay(*spans)).tolist() == sorted(d[3] for d in want)


def test_own_rules(spark):
    rules = (Rule("house", NOTICE, "house rule", "house rules?( [0-9]+)?"), *BASE)
    df = spark.createDataFrame([(1, "House Rule 7; cc by"), (2, "cc0")], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.scanned(df, rules).collect()}
    assert rows[1].labels == "cc-by,house" and rows[1].first_word == 3 and rows[2].labels == ""


def test_hard_rows(spark, hard_documents):
    rows = L.scanned(hard_documents).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in hard_documents.collect()), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want
    assert L.scanned(hard_documents.limit(0)).collect() == []


def test_query_gives_the_contracts_columns(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.op12_license_scan(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(tuple(r)[1:] == brute(texts[r.doc_id]) for r in rows if r.labels)
    assert list(rows[0].asDict()) == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ]
