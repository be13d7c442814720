import re

import numpy as np
import pyarrow as pa

from custvalue.llm import wordhash as W
from custvalue.llm.shared import small_batches, text_parts


def test_words_are_those_of_the_pattern(word_list):
    texts = ["a b", None, "", " \x0b lead", "trail \r\n", "ä b c", "x" * 3_000_000 + " y", "a"]
    seen = {}
    for size in (1, 40, 1 << 22):
        for low, high, data, offsets in text_parts(pa.array(texts), size):
            w = W.words(data, offsets)
            for d in range(low, high):
                a, b = w.first[d - low], w.first[d - low + 1]
                found = [bytes(data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                assert found == word_list(texts[d])
                for word, value in zip(found, w.hashes[a:b].tolist()):
                    assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_large_columns_are_read_from_their_offsets():
    column = pa.array(["zero", "one two", None, "three"], pa.large_string()).slice(1, 2)
    [(low, high, data, offsets)] = list(text_parts(column))
    assert (low, high, bytes(data), offsets.tolist()) == (0, 2, b"one two", [0, 7, 7])


def test_classes_cut_words_between_letters_and_marks():
    classes = np.zeros(256, np.uint8)
    classes[ord("a") : ord("z") + 1], classes[ord(".")] = 1, 2
    data = np.frombuffer(b"ab.c -.d", np.uint8)
    w = W.words(data, np.array([0, len(data)]), classes=classes)
    assert [bytes(data[s:e]) for s, e in zip(w.starts, w.ends)] == [b"ab", b".", b"c", b"-.", b"d"]


def test_equal_runs_have_equal_hashes_and_others_not():
    values = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for size, hashes in W.runs(values, [1, 2, 3, 5, 8, 20]).items():
        by_run = {}
        for i, value in enumerate(hashes.tolist()):
            assert by_run.setdefault(tuple(values[i : i + size].tolist()), value) == value
        assert len(set(by_run.values())) == len(by_run)
    assert all(len(v) == 0 for k, v in W.runs(values[:2], [3, 5]).items())


def test_helpers_count_and_cover():
    assert W.repeated(np.array([3, 1, 3, 2], np.uint64)).tolist() == [True, False, True, False]
    assert W.covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]
    assert W.per_text(np.array([1, 0, 1], bool), np.array([0, 0, 2, 3])).tolist() == [0, 1, 1]
    assert re.match("[0-9]+", str(W.mixed(np.array([5], np.uint64))[0]))


def test_batches_are_made_small_but_never_larger(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, expected in (("64m", str(8 << 20)), ("1k", "1k"), ("100b", "100b")):
        spark.conf.set(key, given)
        small_batches(spark.range(1))
        assert spark.conf.get(key).rstrip("b") == expected.rstrip("b")
    spark.conf.set(key, before)


def _even_odd(length, swap):
    """a and b by the parity of the set bits of each place."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(length))


def test_words_that_meet_in_sums_of_powers_stay_apart(spark, word_list):
    from custvalue.llm import jaccard, rules, substrings

    one, two = _even_odd(1024, 0), _even_odd(1024, 1)
    raw = f"{one}\n{two}".encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 1024, len(raw)])
    assert rules.measure(data, np.array([0, len(raw)]))["n_dup_lines"].tolist() == [0]
    flat, edges = jaccard.shingle_sets(data, offsets)
    assert edges.tolist() == [0, 1, 2] and flat[0] != flat[1]
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{two} {tail}")],
                               "doc_id long, text string")
    lost = {r.doc_id: r.n_removed for r in substrings.without_repeats(df).collect()}
    assert lost == {1: 0, 2: 0, 3: 20}


def test_words_of_near_content_and_any_length_differ():
    base = "".join(chr(97 + i % 26) for i in range(40))
    words = {base[:n] for n in range(1, 41)} | {base[:n] + "\0" for n in range(1, 40)}
    words |= {base[:n - 1] + c for n in (1, 8, 9, 16, 17, 30) for c in "XYZ\0"}
    words |= {c + base[1:n] for n in (8, 9, 15, 16, 17, 30) for c in "XYZ"}
    words = sorted(words)
    raw = " ".join(words).encode()
    w = W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(w.hashes) == len(words) == len(set(w.hashes.tolist()))


def test_nodes_of_equal_first_hash_are_told_apart():
    from custvalue.llm import substrings

    locus, second = np.array([5, 5, 5, 7], np.uint64), np.array([1, 1, 2, 2], "<u2")
    assert substrings._changes(np.arange(4), locus, second).tolist() == [True, False, True, True]
