"""Best-fit decreasing packing of token sequences.

Documents become token ids, the end id is put behind, and only what is longer than a sequence is
cut. Lengths are whole numbers up to the capacity, so the packing of all pieces is decided on
their histogram: longest first, each length goes to the open bins with the tightest remaining
capacity that fits, found in logarithmic time in a segment tree over remaining capacities. Bins in
the same state are handled as one, which gives the very bins that going piece by piece would give.
The plan has as many rows as the capacity asks for, whatever the number of documents; each piece
finds its bin by its rank among the pieces of its length, which is counted on Spark.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as
they occur; ties go by id, piece and checksum, and rows equal in all of these are interchangeable.
A null id is an id like others. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from custvalue.llm import wordhash as W
from custvalue.llm.shared import named, saved, small_batches, text_parts

CAPACITY = 4096
END_ID = 1
_CACHED_WORDS = 1 << 19  # a worker's memory of words; beyond that it keeps those seen again
_ENCODED_WORDS = 8_000  # words the encoder is given at once
_SALT_ROWS = 20_000

# A word may also be cut between an ASCII letter or digit (1) and one of these marks (2): the
# vocabulary splits there too, so the parts have the ids that they have in the whole text.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[48:58] = _CLASSES[65:91] = _CLASSES[97:123] = 1
_CLASSES[np.frombuffer(b".,;:!?", np.uint8)] = 2


class WordIds:
    """Token ids of texts by way of their words, each of which is encoded once per worker.

    White space never lies inside a token of this kind of vocabulary (it is dropped), so the ids
    of a text are those of its words one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.again = np.empty(0, bool)
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _keep_repeated(self) -> None:
        """Forget the words that were looked up in one slice of text only, or all of them where
        those that are left would still fill half the cache."""
        kept = np.flatnonzero(self.again)
        if len(kept) > _CACHED_WORDS // 2:
            return self._clear()
        words = list(self.known)
        length = self.length[kept]
        ends = np.cumsum(length)
        source = np.repeat(self.begin[kept] - (ends - length), length) + np.arange(length.sum())
        flat = self.flat[source]
        self._clear()
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.begin, self.length, self.flat, self.used = ends - length, length, flat, len(flat)
        self.again = np.zeros(len(kept), bool)

    def _learn(self, words: list[bytes]) -> None:
        sizes, flat = [], []
        for low in range(0, len(words), _ENCODED_WORDS):
            texts = [w.decode("utf-8", "replace") for w in words[low : low + _ENCODED_WORDS]]
            some = self.encoder.encode_batch_fast(texts, add_special_tokens=False)
            ids = [e.ids for e in some]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.array(list(chain.from_iterable(ids)), np.uint32))
        length, more = np.concatenate(sizes), np.concatenate(flat)
        if self.used + len(more) > len(self.flat):
            grown = np.empty(max(len(self.flat) * 2, self.used + len(more)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(more)] = more
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])
        self.used += len(more)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each of several different words in the cache, which must have room for
        all of them at once."""
        new = [word for word in words if word not in self.known]
        if new and len(self.known) + len(new) > _CACHED_WORDS:
            self._keep_repeated()
            new = [word for word in words if word not in self.known]
            if len(self.known) + len(new) > _CACHED_WORDS:
                self._clear()
                new = words
        before = len(self.known)
        if new:
            self._learn(new)
        place = np.fromiter((self.known[word] for word in words), np.int64, len(words))
        self.again[place[place < before]] = True
        return place

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts in one array, and where each text's begin."""
        folded = _folded(data)
        w = W.words(folded, offsets, classes=_CLASSES)
        edges = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(w.starts),
            [None, pa.py_buffer(edges), pa.py_buffer(folded[~W.SPACE[folded]])],
        )
        # In slices, each of which the cache can hold whole.
        step = max(1, _CACHED_WORDS // 2)
        found, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for low in range(0, len(words), step):
            coded = words.slice(low, step).dictionary_encode()
            place = self._numbers(coded.dictionary.to_pylist())
            place = place[coded.indices.to_numpy(zero_copy_only=False)]
            length = self.length[place]
            ends = np.cumsum(length)
            source = np.repeat(self.begin[place] - (ends - length), length) + np.arange(ends[-1])
            found.append(self.flat[source])
            sizes.append(length)
        begins = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(found), begins[w.first]


def _folded(data: np.ndarray) -> np.ndarray:
    """Upper case folded early, so that more words are known: only where no special token can be
    spelled, and not before a byte that may begin a mark which the vocabulary composes with the
    letter."""
    if b"<|" in data.tobytes():
        return data
    plain = np.ones(len(data), bool)
    plain[:-1] = data[1:] < 128
    return np.where(plain, W.LOWER[data], data)


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column(1), 1 << 21):
                ids, begins = encoder.ids(data, offsets)
                # Room for the end id behind every document.
                every = np.full(len(ids) + high - low, end_id, "<u4")
                edges = begins + np.arange(len(begins))
                every[np.arange(len(ids)) + np.repeat(np.arange(high - low), np.diff(begins))] = ids
                sizes = np.diff(edges)
                count = -(-sizes // capacity)
                owner = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                first = edges[owner] + start
                parts = [every[a : a + n] for a, n in zip(first.tolist(), length.tolist())]
                columns = {
                    "doc_id": batch.column(0).slice(low, high - low).take(pa.array(owner)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start.astype(np.int64)),
                    "length": pa.array(length.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([p.tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, on demand, ``ids`` as unsigned
    little-endian 32-bit numbers. ``tokenizer`` is the path of a vocabulary file whose words end
    at white space; every executor must have it there."""
    rows = docs.select(named(id_column), named(text_column))
    schema = (
        f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, "
        "ids_crc32 long" + (", ids binary" if with_ids else "")
    )
    return small_batches(rows).mapInArrow(_cut(tokenizer, end_id, capacity, with_ids), schema)


class _Tree:
    """A segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def put(self, remaining: int, some: bool) -> None:
        node = remaining + self.size
        self.some[node] = some
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``length``."""
        node = length + self.size
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


@dataclass(frozen=True)
class Plan:
    """Steps: ranks from ``rank`` on of ``length`` fill bins from ``bin`` on, ``each`` pieces
    per bin, the first of a bin at ``offset``. Sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces given by length and rank."""
        key = (self.length << np.int64(48)) + self.rank
        step = np.searchsorted(key, (length << np.int64(48)) + rank, "right") - 1
        nth = rank - self.rank[step]
        bins = self.bin[step] + nth // self.each[step]
        return bins, self.offset[step] + nth % self.each[step] * length


def best_fit(histogram: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """The best-fit decreasing packing of so many pieces of each length."""
    tree = _Tree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            if not open_.setdefault(remaining, []):
                tree.put(remaining, True)
            open_[remaining].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[remaining].pop()
                if not open_[remaining]:
                    tree.put(remaining, False)
            each = remaining // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, first, each, capacity - remaining))
                keep(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last pieces of this length, fewer than one bin takes
                steps.append((length, rank, first + full, each, capacity - remaining))
                keep(remaining - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            keep(remaining, first + full, n - full)
    columns = np.array(sorted(steps), np.int64).reshape(-1, 5).T
    return Plan(*columns, bins=bins)


def packed(parts: DataFrame, capacity: int = CAPACITY, saved_already: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, gapless in each sequence from 0.

    ``parts`` is read several times; unless it is a stored table it is stored first.
    """
    parts = parts if saved_already else saved(parts)
    total = parts.count()
    salts = max(1, -(-total // _SALT_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts))
    rows = parts.withColumn("__salt", salt)
    counts = rows.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    histogram = {
        row["length"]: row["n"]
        for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    plan = parts.sparkSession.sparkContext.broadcast(best_fit(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(
        "length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")
    )
    nth = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("__nth", F.row_number().over(nth))
        .join(bases, ["length", "__salt"])
        .withColumn("__rank", F.col("__base") + F.col("__nth") - 1)
    )

    names = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            bins, offset = plan.value.place(length, rank)
            out = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(
                out | {"sequence_id": pa.array(bins), "offset": pa.array(offset)}
            )

    placed = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])
    schema = StructType(parts.schema.fields + placed.fields)
    return ranked.select(*names, "__rank").mapInArrow(place, schema)
