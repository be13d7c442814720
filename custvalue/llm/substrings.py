"""Substring dedup with prefix-partitioned suffix trees.

Every place from which at least ``window`` words of a document remain starts a suffix. Suffixes
are split into groups by a prefix of variable length: 1, 2, 4, 8 or 16 words, the first that few
enough suffixes share, or the whole window. A sample finds the crowded prefixes; it only steers
where a suffix goes, so it cannot change a result. Each group is one task's worth of memory and
holds whole subtrees. In a subtree the nodes at depth ``window`` are the classes of suffixes that
share their first ``window`` words; those with two or more leaves are its deep internal nodes.
The leaf that comes first in (document id, start) stays, and the words below every other leaf are
marked. Neighbouring marks of a document join to its maximal repeats.

Suffixes are ordered by hashes of word runs, not by their letters: only classes matter here, not
alphabetical order. Leaves share a node if two hashes of the window, of 64 and 16 bits, agree.
They are only compared inside a group, which another hash has chosen: over 1.5e13 windows (about
100 TB) in groups of some 700,000 less than 1e-5 false pairs are to be expected. Within a batch of documents a node sends only its first leaf on,
the others are marked on the spot, so a passage that a third of all documents share costs each
group one leaf per batch, never one per document.

Defined results: null and empty texts, and texts shorter than the window, lose nothing. Windows
are judged on the input. Of equal texts the one with the smallest id stays whole. Rows that share
a document id are the same document: a window counts as earlier there only if its start is
smaller. A null id counts as the smallest. An empty table gives an empty table. Input columns
are kept; the result's own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from custvalue.llm import wordhash as W
from custvalue.llm.shared import NO_ID, give_back, named, saved, small_batches, text_parts

WINDOW = 20
GROUP_BYTES = 4 << 20  # text bytes whose suffixes make one group
SAMPLE_BYTES = 2 << 20  # text bytes, about, that are looked at for crowded prefixes
_LEVELS = (1, 2, 4, 8, 16)
_OTHER = np.uint64(0xA0761D6478BD642F)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Integers as planes of bytes: their many zero bytes then compress to nothing."""
    size = np.dtype(kind).itemsize
    return values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, levels: tuple[int, ...]):
    """Starts of the suffixes, their words, and hashes of their prefixes by length."""
    w = W.words(data, offsets)
    hashes = W.runs(w.hashes, [*levels, window])
    starts = np.flatnonzero(w.room()[: len(hashes[window])] >= window)
    return w, starts, {k: v[starts] for k, v in hashes.items()}


def _second(w: W.Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Sixteen more bits for the window from each start, from other numbers of the words."""
    run = W.runs(W.mixed(w.hashes + _OTHER), [window])[window]
    return (run[starts] >> np.uint64(48)).astype("<u2")


def _changes(order: np.ndarray, locus: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Mask of the leaves, in this order, that begin another node."""
    new = np.ones(len(order), bool)
    new[1:] = locus[order[1:]] != locus[order[:-1]]
    new[1:] |= second[order[1:]] != second[order[:-1]]
    return new


def _crowded_counts(window: int):
    levels = tuple(k for k in _LEVELS if k < window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_parts(batch.column(0)):
                _, _, hashes = _windows(data, offsets, window, levels)
                for level in levels:
                    values, n = np.unique(hashes[level], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "level": pa.array(np.full(len(values), level, np.int32)),
                            "prefix": pa.array(values.view(np.int64)),
                            "n": pa.array(n),
                        }
                    )

    return count


def crowded_prefixes(
    texts: DataFrame, total: int, window: int, group_bytes: int
) -> dict[int, np.ndarray]:
    """Prefix hashes by length that too many suffixes share for one group, from a sample.

    At most the sampled words divided by the limit come to the driver: a few hundred numbers.
    """
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    sample = texts.where(F.pmod(F.xxhash64("id", "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    limit = max(group_bytes / 6 / 16 * share, 40)
    found = (
        sample.select("text")
        .mapInArrow(_crowded_counts(window), "level int, prefix long, n long")
        .groupBy("level", "prefix")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= limit)
        .collect()
    )
    out: dict[int, list[int]] = {}
    for row in found:
        out.setdefault(row.level, []).append(row.prefix)
    return {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in out.items()}


def _leaves(groups: int, crowded: dict[int, np.ndarray], window: int):
    """Suffixes of each batch, by group: the first leaf of every node, and marks of the rest."""
    levels = tuple(k for k in _LEVELS if k < window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.sort_by("id").combine_chunks()
            ids = table.column("id").to_numpy()
            keys = table.column("key").to_numpy()
            for low, high, data, offsets in text_parts(table.column("text")):
                rows = _batch_rows(ids[low:high], keys[low:high], data, offsets)
                if rows:
                    yield rows

    def _batch_rows(ids, keys, data, offsets):
        w, starts, hashes = _windows(data, offsets, window, levels)
        if not len(starts):
            return None
        text = w.text_of()[starts]
        place = starts - w.first[text]
        locus = hashes[window]
        # Texts lie in order of id, so the first leaf in order of rows is the first of its node.
        second = _second(w, starts, window)
        order = np.argsort(locus, kind="stable")
        one = locus[order[1:]] == locus[order[:-1]]
        if (one & (second[order[1:]] != second[order[:-1]])).any() or len(np.unique(ids)) < len(ids):
            order = np.lexsort((place, ids[text], second, locus))
        new = _changes(order, locus, second)
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = (ids[text[head]] != ids[text[order]]) | (place[head] != place[order])
        # Rows that repeat a document id may hold several leaves at the node's first place.
        first = np.zeros(len(order), bool)
        first[order[~later]] = True
        prefix, open_ = locus.copy(), np.ones(len(locus), bool)
        for level in levels:
            many = crowded.get(level)
            here = open_.copy()
            if many is not None:
                spot = np.minimum(np.searchsorted(many, hashes[level]), len(many) - 1)
                here &= many[spot] != hashes[level]
            prefix[here] = hashes[level][here]
            open_ &= ~here
        group = (W.mixed(prefix) % np.uint64(groups)).astype(np.int64)
        by_group = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[by_group], np.arange(groups + 1))
        rows = []
        full = np.flatnonzero(np.diff(edges))
        for g in full.tolist():
            mine = by_group[edges[g] : edges[g + 1]]
            used = np.unique(text[mine])
            rows.append(
                (
                    _planes(np.diff(ids[used], prepend=0), "<i8"),
                    _planes(keys[used], "<i2"),
                    _planes(np.diff(w.first[used], prepend=0), "<u4"),
                    _planes(np.diff(starts[mine], prepend=0), "<u4"),
                    np.packbits(first[mine]).tobytes(),
                    locus[mine[first[mine]]].tobytes(),
                    second[mine[first[mine]]].tobytes(),
                )
            )
        columns = [pa.array(column, pa.binary()) for column in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(full), *columns], names=_LEAF_NAMES)

    return cut


_LEAF_NAMES = ["part", "ids", "keys", "bounds", "starts", "first", "locus", "second"]
_LEAF = "part long, " + ", ".join(f"{name} binary" for name in _LEAF_NAMES[1:])


def _later(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, place) of all but the first leaf of each node of a group's subtrees."""
    loci, seconds, leaves, marked = [], [], [], []
    for row in group.select(_LEAF_NAMES[1:]).to_pylist():
        ids = np.cumsum(_unplaned(row["ids"], "<i8"))
        keys = _unplaned(row["keys"], "<i2")
        bounds = np.cumsum(_unplaned(row["bounds"], "<u4").astype(np.int64))
        starts = np.cumsum(_unplaned(row["starts"], "<u4").astype(np.int64))
        text = np.searchsorted(bounds, starts, "right") - 1
        leaf = np.stack([ids[text], keys[text].astype(np.int64), starts - bounds[text]])
        first = np.unpackbits(np.frombuffer(row["first"], np.uint8), count=len(starts)).astype(bool)
        loci.append(np.frombuffer(row["locus"], np.uint64))
        seconds.append(np.frombuffer(row["second"], "<u2"))
        leaves.append(leaf[:, first])
        marked.append(leaf[:, ~first])
    locus, (ids, keys, place) = np.concatenate(loci), np.concatenate(leaves, axis=1)
    second = np.concatenate(seconds)
    many = np.flatnonzero(W.repeated(locus))
    order = many[np.lexsort((place[many], ids[many], second[many], locus[many]))]
    new = _changes(order, locus, second)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = order[(ids[head] != ids[order]) | (place[head] != place[order])]
    return tuple(
        np.concatenate([column[later], *[m[i] for m in marked]])
        for i, column in enumerate((ids, keys, place))
    )


def _marks(buckets: int):
    """A group's marks, packed into one row for each bucket of documents."""

    def mark(group: pa.Table) -> pa.Table:
        id_, key, place = _later(group)
        bucket = (W.mixed(id_.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, key, id_, bucket))
        id_, key, place, bucket = id_[order], key[order], place[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        columns: list[list[bytes]] = [[], [], []]
        for b in full.tolist():
            mine = slice(edges[b], edges[b + 1])
            columns[0].append(_planes(np.diff(id_[mine], prepend=0), "<i8"))
            columns[1].append(_planes(key[mine], "<i2"))
            columns[2].append(_planes(place[mine], "<u4"))
        give_back()
        return pa.table(
            [pa.array(full), *[pa.array(c, pa.binary()) for c in columns]],
            names=["bucket", "ids", "keys", "places"],
        )

    return mark


def _by_document(bucket: pa.Table) -> pa.Table:
    """The marks of a bucket's documents from all groups, one row per document text."""
    rows = bucket.select(["ids", "keys", "places"]).to_pylist()
    id_ = np.concatenate([np.cumsum(_unplaned(r["ids"], "<i8")) for r in rows])
    key = np.concatenate([_unplaned(r["keys"], "<i2") for r in rows])
    place = np.concatenate([_unplaned(r["places"], "<u4") for r in rows])
    order = np.lexsort((place, key, id_))
    id_, key, place = id_[order], key[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (id_[1:] != id_[:-1]) | (key[1:] != key[:-1])
    edges = np.append(np.flatnonzero(new), len(order))
    spans = zip(edges[:-1].tolist(), edges[1:].tolist())
    return pa.table(
        {
            "id": pa.array(id_[edges[:-1]], pa.int64()),
            "key": pa.array(key[edges[:-1]].astype(np.int64)),
            "places": pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _removed(window: int, text_at: int, marks_at: int, spans: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(text_at), batch.column(marks_at)
            n_words, n_removed, kept, found = [], [], [], []
            for text, mark in zip(texts, marks):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n_words.append(len(words))
                runs: list[dict] = []
                lost = 0
                if mark.is_valid:
                    starts = np.frombuffer(mark.as_py(), "<u4")
                    gone = W.covered(starts.astype(np.int64), window, len(words))
                    lost = int(gone.sum())
                    if spans:
                        step = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                        runs = [
                            {"start": int(a), "end": int(b)} for a, b in zip(step[::2], step[1::2])
                        ]
                    words = [word for word, out in zip(words, gone.tolist()) if not out]
                n_removed.append(lost)
                found.append(runs)
                kept.append(b" ".join(words))
            columns = [c for i, c in enumerate(batch.columns) if i != marks_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != marks_at]
            extra = {
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
            if spans:
                kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                extra["removed_spans"] = pa.array(found, pa.list_(kind))
            yield pa.RecordBatch.from_arrays([*columns, *extra.values()], [*names, *extra])

    return strip


def _key(text_column: str) -> Column:
    """Sixteen bits of a text's hash: keeps rows apart that share an id but not the text."""
    low = F.pmod(F.xxhash64(named(text_column)), F.lit(1 << 16))
    return (low - (1 << 15)).cast("long")


def repeat_marks(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(id, key, places): starts of the windows that occur earlier, one row per document text."""
    texts = docs.select(
        F.coalesce(named(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        _key(text_column).alias("key"),
        named(text_column).alias("text"),
    ).where("text IS NOT NULL")
    texts = small_batches(texts)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    crowded = crowded_prefixes(texts, total, window, group_bytes)
    leaves = texts.mapInArrow(_leaves(groups, crowded, window), _LEAF)
    marks = leaves.groupBy("part").applyInArrow(
        _marks(groups), "bucket long, ids binary, keys binary, places binary"
    )
    return marks.groupBy("bucket").applyInArrow(
        _by_document, "id long, key long, places binary"
    )


def without_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
    spans: bool = False,
) -> DataFrame:
    """The input rows with ``n_words``, ``n_removed`` and ``kept_text``: the text without the
    words that an earlier window covers, its words joined by one space. ``spans`` adds
    ``removed_spans``, the maximal repeats as word ranges."""
    own = {"n_words", "n_removed", "kept_text", "removed_spans"} - {id_column, text_column}
    columns = [c for c in docs.columns if c not in own]
    marks = saved(repeat_marks(docs, id_column, text_column, window, group_bytes))
    marks = marks.withColumnsRenamed({"id": "__id", "key": "__key", "places": "__places"})
    rows = docs.select(*map(named, columns))
    mine = F.coalesce(named(id_column).cast("long"), F.lit(NO_ID))
    joined = rows.join(
        marks,
        (mine == F.col("__id")) & (_key(text_column) == F.col("__key")),
        "left",
    ).select(*map(named, columns), "__places")
    added = [("n_words", LongType()), ("n_removed", LongType()), ("kept_text", StringType())]
    if spans:
        span = StructType([StructField("start", LongType()), StructField("end", LongType())])
        added.append(("removed_spans", ArrayType(span)))
    schema = StructType(rows.schema.fields + [StructField(n, kind) for n, kind in added])
    strip = _removed(window, columns.index(text_column), len(columns), spans)
    return joined.mapInArrow(strip, schema)
