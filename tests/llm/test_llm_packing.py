import bisect
import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from custvalue.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_bins(lengths, capacity):
    open_, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(open_, (length, -1))
        if at == len(open_):
            left, name, bins = capacity, bins, bins + 1
        else:
            left, name = open_.pop(at)
        if left - length:
            bisect.insort(open_, (left - length, name))
    return bins


def test_plan_equals_packing_piece_by_piece():
    rng = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
        counts = collections.Counter(lengths)
        plan = P.best_fit(counts, capacity)
        assert plan.bins == brute_bins(lengths, capacity)
        rank = np.concatenate([np.arange(n) for _, n in sorted(counts.items())])
        bins, offset = plan.place(np.array(sorted(lengths), np.int64), rank)
        gapless(zip(bins.tolist(), offset.tolist(), sorted(lengths)), capacity)
    assert P.best_fit({}).bins == 0


def gapless(rows, capacity):
    by_bin = collections.defaultdict(list)
    for name, offset, length in rows:
        by_bin[name].append((offset, length))
    for content in by_bin.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_bin)


TEXTS = [
    "The quick brown Fox's tail, isn't it? 3.14!", "", None, "a.b,c;d!e?f:g", "Ünïcode — ЖЖ 漢字",
    "<|endoftext|> mid <|startoftext|>X", "x" * 700, "é. Å, İ!", "'s.'t 'RE",
    "word " * 9000, "tab\tnew\nline nbsp em", "!!!??? ...", "1,2.3:4",
]


@pytest.mark.parametrize("capacity", [4096, 7])
def test_pieces_hold_the_ids_of_the_whole_text(spark, capacity):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    rows = P.pieces(df, PATH, capacity=capacity, with_ids=True).collect()
    encoder = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), capacity))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        for r in mine:
            part = np.array(ids[r.start : r.start + capacity], "<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))


def test_words_are_learned_anew_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(P, "_CACHED_WORDS", 40)
    encoder, plain = P.WordIds(PATH), Tokenizer.from_file(PATH)
    for round_ in range(5):
        text = " ".join(f"tok{round_}x{i}" for i in range(30)) + " same words"
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.ids(data, np.array([0, len(data)]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    text = " ".join(f"many{i}" for i in range(100))
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = encoder.ids(data, np.array([0, len(data)]))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_full_memory_keeps_the_words_seen_again(monkeypatch):
    monkeypatch.setattr(P, "_CACHED_WORDS", 100)
    worker = P.WordIds(PATH)
    often = [f"often{letter}" for letter in "abcdefghij"]
    for round_ in range(12):
        text = " ".join([*often, *(f"once{round_}x{i}" for i in range(15))])
        assert encoded(worker, [text]) == wanted([text])
        assert len(worker.known) <= 100 and len(worker.again) == len(worker.known)
        if round_:
            assert all(word.encode() in worker.known for word in often)
            learned, worker._learn = [], lambda words, f=worker._learn: (learned.extend(words), f(words))[1]
            assert encoded(worker, [" ".join(often)]) == wanted([" ".join(often)])
            assert not learned
            del worker._learn


def test_packed_rows(spark, hard_documents, monkeypatch):
    monkeypatch.setattr(P, "_SALT_ROWS", 3)
    rows = P.packed(P.pieces(hard_documents, PATH)).collect()
    assert gapless(((r.sequence_id, r.offset, r.length) for r in rows), 4096) == len(
        {r.sequence_id for r in rows}
    )
    assert sum(r.doc_id == 8 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert len({r.sequence_id for r in rows}) == brute_bins([r.length for r in rows], 4096)
    assert P.packed(P.pieces(hard_documents.limit(0), PATH)).collect() == []


def encoded(worker, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, begins = worker.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]


def wanted(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("known", [10, 60, 90])
def test_a_text_with_more_words_than_the_cache_holds(monkeypatch, known):
    monkeypatch.setattr(P, "_CACHED_WORDS", 100)
    worker = P.WordIds(PATH)
    old = " ".join(f"old{i}" for i in range(known))
    new = " ".join(f"old{i} new{i}" for i in range(160))
    texts = [old, new + " old3", "", new + " end"]
    for text in (texts[:1], texts):
        assert encoded(worker, text) == wanted(text)


def test_words_of_equal_hash_keep_their_own_ids():
    # Thue-Morse orders of two letters meet in any sum of bytes times powers modulo 2**64.
    order = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[bit ^ flip] for bit in order) for flip in (0, 1)]
    worker = P.WordIds(PATH)
    assert encoded(worker, texts) == wanted(texts)
    assert encoded(worker, texts)[0] != encoded(worker, texts)[1]


def test_letters_before_marks_are_composed_as_the_vocabulary_does():
    texts = ["İ̸", "İ", "Å B", "Aİ̸x", "ÉCOLE É"]
    assert encoded(P.WordIds(PATH), texts) == wanted(texts)
