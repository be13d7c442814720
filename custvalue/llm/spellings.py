"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols, so that a word has a small full neighbourhood: its reduced
form itself (an edit may stay inside one symbol), every replacement by another symbol, and every
deletion. Each pair is found from one side: replacements only go to larger symbols, and an
insertion is a deletion seen from the longer word. The neighbourhoods meet the reduced vocabulary
in one join on their codes; what meets is verified on the original words. Codes are hashes of
reduced words, so equal codes only propose a pair.

A reduced form that more than ``CROWDED`` words share is not met as a whole: there, words must also
share the word itself or the word less one letter, and at most a few hundred words do.

Defined results: null and empty texts have no words. A null id counts as an empty one where
letters are dropped. Repeated rows count as often as they stand there. Ties between near words of
equal count go to the smaller word in code-point order. An empty table gives an empty table. Other
columns are not read, whatever their names. A word may be of any length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm.shared import Scratch, named, saved, small_batches, text_parts
from custvalue.llm.wordhash import LOWER, mixed

SYMBOLS = 8
CROWDED = 64
DROP_ONE_IN = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LETTERS_AT_ONCE = 1 << 17
_SHORT = 40  # letters of the longest word that travels whole


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = 0xC3  # first of the two bytes of U+00C0 to U+00FF


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The lower-cased runs of at least ``LEAST_LETTERS`` letters: number of the text, run."""
    inside = _LETTER[data]
    latin = data == _LATIN
    inside |= latin
    inside[1:] |= latin[:-1]
    joined = inside[1:] & inside[:-1]
    breaks = offsets[(offsets > 0) & (offsets < len(data))]
    joined[breaks - 1] = False
    opening, closing = inside.copy(), inside
    opening[1:] &= ~joined
    closing[:-1] &= ~joined
    starts, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[ends] - points[starts] >= LEAST_LETTERS
    starts, ends = starts[long], ends[long]
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] = 1
    change[ends] -= 1
    kept = LOWER[data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]]
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    runs = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(kept)
    )
    return np.searchsorted(offsets, starts, "right") - 1, runs


def _noisy_counts(ids: list[str], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    owner, runs = _runs(data, offsets)
    coded = runs.dictionary_encode()
    words = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, times = np.unique(owner * max(len(words), 1) + code, return_counts=True)
    doc, code = np.divmod(pairs, max(len(words), 1))
    begun = [zlib.crc32(f"{i}:".encode()) for i in ids]
    spelled = words.cast(pa.large_binary()).to_pylist()
    sums = np.array(
        [zlib.crc32(spelled[c], begun[d]) for d, c in zip(doc.tolist(), code.tolist())], np.int64
    )
    losing = sums % DROP_ONE_IN == 0
    whole = np.bincount(code[~losing], times[~losing], minlength=len(words)).astype(np.int64)
    shorter, n = [], []
    for c, h, t in zip(code[losing].tolist(), sums[losing].tolist(), times[losing].tolist()):
        word = spelled[c].decode()
        at = h % len(word)
        if len(word) > LEAST_LETTERS:
            shorter.append(word[:at] + word[at + 1 :])
            n.append(t)
    there = np.flatnonzero(whole)
    names = pa.concat_arrays([words.take(pa.array(there)), pa.array(shorter, pa.large_string())])
    counts = np.concatenate([whole[there], np.array(n, np.int64)])
    return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(counts)], ["word", "n"])


def noisy_words(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Runs of letters of at least ``LEAST_LETTERS`` code points, lower-cased in A-Z, with how
    often each occurs in some of the texts (``word``, ``n``: to be summed). A run loses one letter
    where ``DROP_ONE_IN`` divides the checksum of its text's id and itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in text_parts(batch.column(1)):
                yield _noisy_counts(ids[low:high], data, offsets)

    rows = docs.select(
        F.coalesce(named(id_column).cast("string"), F.lit("")), named(text_column)
    )
    return small_batches(rows).mapInArrow(count, "word string, n long")


def counted(words: DataFrame) -> DataFrame:
    """Each word and how often it occurs (``n``), at least ``LEAST_COUNT`` times."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet for so many words: more words, more symbols, so that few
    of them share a reduced form."""
    return max(SYMBOLS, math.ceil(SYMBOLS * (words / 2**19) ** 0.25))


class _Letters:
    """The letters of several words in one array, hashed by place, with sums for any edit."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.values = values.astype(np.uint64) + np.uint64(1)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        place = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _BASE, np.uint64))
        self.power = powers[place]
        part = self.values * self.power
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        first = sums[ends - lengths]
        self.whole = sums[ends] - first
        before = sums[:-1] - first[self.owner]
        self.less_one = before + (self.whole[self.owner] - before - part) * np.uint64(_INVERSE)

    def code(self, sums: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed(sums + mixed(length.astype(np.uint64))).view(np.int64)

    def own(self) -> np.ndarray:
        return self.code(self.whole, self.lengths)

    def deletions(self) -> np.ndarray:
        return self.code(self.less_one, self.lengths[self.owner] - 1)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return points, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _symbols(points: np.ndarray, symbols: int) -> np.ndarray:
    return mixed(points.astype(np.uint64)) % np.uint64(symbols)


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, low = np.cumsum(lengths), 0
    while low < len(lengths):
        base = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, base + _LETTERS_AT_ONCE, "right")), low + 1)
        yield low, high
        low = high


def _by_slice(words: DataFrame, name: str, make) -> DataFrame:
    """``make(words, points, lengths)`` gives owners and codes; rows are (``name``, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for low, high in _slices(sizes):
                points, lengths = _letters(batch.column(1).slice(low, high - low))
                owner, codes = make(points, lengths)
                shown = batch.column(0).slice(low, high - low)
                for a in range(0, len(codes), 1 << 16):
                    some = owner[a : a + (1 << 16)], codes[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [shown.take(pa.array(some[0])), pa.array(some[1])], [name, "code"]
                    )

    kind = words.schema[name].dataType.simpleString()
    return words.select(F.col(name).alias("__of"), "word").mapInArrow(
        run, f"{name} {kind}, code long"
    )


def reduced(words: DataFrame, symbols: int = SYMBOLS, name: str = "word") -> DataFrame:
    """The code of the reduced form of each word, beside its column ``name``."""

    def make(points, lengths):
        letters = _Letters(_symbols(points, symbols), lengths)
        return np.arange(len(lengths)), letters.own()

    return _by_slice(words, name, make)


def neighbourhoods(words: DataFrame, symbols: int = SYMBOLS, name: str = "word") -> DataFrame:
    """The codes of the one-edit neighbourhood of each reduced form, each once."""

    def make(points, lengths):
        values = _symbols(points, symbols)
        letters = _Letters(values, lengths)
        owner = [np.arange(len(lengths)), letters.owner]
        codes = [letters.own(), letters.deletions()]
        for symbol in range(1, symbols):
            at = np.flatnonzero(values < symbol)
            who = letters.owner[at]
            change = (np.uint64(symbol) - values[at]) * letters.power[at]
            owner.append(who)
            codes.append(letters.code(letters.whole[who] + change, lengths[who]))
        return _distinct(np.concatenate(owner), np.concatenate(codes))

    return _by_slice(words, name, make)


def _less_one(words: DataFrame) -> DataFrame:
    """Codes (``less``) of the whole word and of the word less one letter, over all letters."""

    def make(points, lengths):
        letters = _Letters(points, lengths)
        owner = np.concatenate([np.arange(len(lengths)), letters.owner])
        return _distinct(owner, np.concatenate([letters.own(), letters.deletions()]))

    return _by_slice(words, "id", make).withColumnRenamed("code", "less")


def _distinct(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    return owner[new], codes[new]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``: what follows the
    first difference must be equal, so the time is in proportion to the length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), "<u4") for w in (a, b))
    differ = x != y[: len(x)]
    first = int(differ.argmax()) if differ.any() else len(x)
    return np.array_equal(x[first + (len(x) == len(y)) :], y[first + 1 :])


def _long_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (1, 2))
        right = [y is None or one_edit(x, y) for x, y in zip(a, b)]
        yield batch.filter(pa.array(right, pa.bool_()))


def _verified(pairs: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """Pairs (code, a, b) of ``name`` that are one edit apart, as words (code, a_word, b_word). A
    pair whose b is null is not decided yet and stays."""
    if name == "word":
        pairs = pairs.withColumnsRenamed({"a": "a_word", "b": "b_word"})
        one = F.levenshtein("a_word", "b_word", 1) == 1
        return pairs.where(F.col("b_word").isNull() | one)
    for side in "ab":
        own = words.select(F.col(name).alias(side), F.col("word").alias(f"{side}_word"))
        pairs = pairs.join(own, side, "left")
    pairs = small_batches(pairs.select("code", "a_word", "b_word"))
    return pairs.mapInArrow(_long_pairs, pairs.schema)


def _pairs(
    words: DataFrame, name: str, scratch: Scratch, symbols: int, crowded: int
) -> DataFrame:
    """Words (a_word, b_word) one edit apart. ``name`` is the column that stands for a word while
    reduced forms meet: the word, or a number where words are long."""
    codes = scratch.saved(reduced(words, symbols, name))
    sizes = codes.groupBy("code").agg(F.count("*").alias("members"))
    full = scratch.saved(sizes.where(F.col("members") > crowded).select("code"))
    single = codes.join(full, "code", "left_anti").withColumnRenamed(name, "b")
    as_one = full.withColumn("b", F.lit(None).cast(codes.schema[name].dataType))
    around = neighbourhoods(words, symbols, name).withColumnRenamed(name, "a")
    met = around.join(single.unionByName(as_one), "code").where("b IS NULL OR a <> b")
    met = scratch.saved(_verified(met, words, name).select("code", "a_word", "b_word"))
    found = met.where("b_word IS NOT NULL").select("a_word", "b_word")
    if full.isEmpty():
        return found
    # At a crowded form: by form and by what is left of the word less one letter.
    at = met.where("b_word IS NULL").select("code", F.col("a_word").alias("word"))
    members = words.join(codes.join(full, "code", "left_semi"), name).select("code", "word")
    less = scratch.saved(_less_one(words))
    number = words.select("word", "id")
    sides = [
        table.join(number, "word").join(less, "id").select("code", "less", F.col(name).alias(side))
        for side, table in (("a", at), ("b", members))
    ]
    more = sides[0].join(sides[1], ["code", "less"]).where("a <> b").select("code", "a", "b")
    return found.unionByName(_verified(more, words, name).select("a_word", "b_word"))


def near_pairs(
    vocabulary: DataFrame, scratch: Scratch, symbols: int, crowded: int = CROWDED
) -> DataFrame:
    """Each two words of ``vocabulary`` (id, word) that are one edit apart, once (a_word, b_word).

    Short words travel with the codes of their neighbourhood and are compared where these meet;
    of long ones, which have many codes, only the number does. Words of ``_SHORT`` letters go
    both ways, so that each pair is on one of them.
    """
    letters = F.length("word")
    short = vocabulary.where(letters <= _SHORT)
    long = scratch.saved(vocabulary.where(letters >= _SHORT))
    pairs = _pairs(short, "word", scratch, symbols, crowded)
    if not long.isEmpty():
        pairs = pairs.unionByName(_pairs(long, "id", scratch, symbols, crowded))
    # A pair within one form comes from both sides.
    return pairs.select(
        F.least("a_word", "b_word").alias("a_word"), F.greatest("a_word", "b_word").alias("b_word")
    ).distinct()


def variant_groups(
    counts: DataFrame,
    ratio: int = RATIO,
    symbols: int | None = None,
    crowded: int = CROWDED,
) -> DataFrame:
    """Per word of ``counts`` (word, n; each word once): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest count where that is at least ``ratio`` times the word's;
    ``root`` follows forms to the last.
    """
    scratch = Scratch()
    vocabulary = saved(
        counts.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    )
    symbols = symbols or symbols_for(vocabulary.count())
    pairs = scratch.saved(near_pairs(vocabulary, scratch, symbols, crowded))
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near")),
                F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near")),
            )
        ).alias("end")
    ).select("end.*")
    near_n = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = ends.join(near_n, "near").groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    strong = -F.col("best.less") >= ratio * F.col("n")
    judged = saved(
        vocabulary.drop("id").join(best, "word", "left").select(
            "word",
            F.when(strong, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    scratch.clear()
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"), judged, ratio)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame, judged: DataFrame, ratio: int) -> DataFrame:
    """The last word that forms lead to, by doubling: counts grow ``ratio``-fold along a chain,
    so the chain's length is bounded by their range."""
    edges = judged.agg(F.min("n"), F.max("n")).first()
    hops = int(math.log(edges[1] / edges[0], ratio)) + 1 if edges[0] else 0
    roots = links.withColumnRenamed("form", "root")
    for _ in range(max(hops, 1).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = saved(
            roots.join(further, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root")
            )
        )
    return roots


def variants_of(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The variant groups of the words of all texts."""
    return variant_groups(counted(noisy_words(docs, id_column, text_column)))
