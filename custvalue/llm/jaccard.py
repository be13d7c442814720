"""Exact Jaccard self-join on word shingles by universe partitions and the pigeonhole.

A document is the set of its distinct five-word shingles. Two sets of sizes x and y reach the
threshold only if at most H shingles lie in one of them alone, and H depends on x alone when y may
be any size that can reach it. Per size band the universe of shingles is cut by a hash into
segments; a set goes to its own band and to every higher band that could hold a partner.

Of the segments a set indexes a subset whose allocation reaches H + 1, so that in any pair that
reaches the threshold one indexed segment meets. The allocation goes by cost:

* 0 for a segment that is empty, or crowded: many sets share it, as with boilerplate (seen in a
  sample, so what counts as crowded steers the work and never the result);
* 1 for a segment indexed as it is: the cheapest, the first H + 1 of them in order are taken. Both
  sets of a pair take the first ones, and crowded segments are crowded for both, so the shorter
  of the two runs holds a segment that both index;
* 2 for a segment indexed with its one-deletion neighbourhood, where a set has too few segments:
  small sets, whose bands have few and long segments on purpose, since segments of one or two
  shingles would meet by chance. If even that does not reach H + 1, empty segments count too.

Entries with a bounded number of members are paired; pairs whose sizes or sketches (counts of
shingles by hash, which bound the difference from below) rule each other out are dropped, and the
rest are verified on their whole sets. A set made of crowded segments, one of thousands of near
copies, indexes those apart, and so are entries with more members. What such entries tie together
is a family: it is cut into blocks, every two blocks meet in a cell with their whole sets, and a
cell returns one link per member to the smallest one that links reach there, never its pairs.

Equal sets are one class from the start; copies are never paired. Shingles and sets are known by
64-bit hashes.

Defined results: a null text, or one without words, has no shingles and stands alone. With fewer
than five words the whole sequence is the only shingle. Rows that repeat an id are one document
with several texts: each row gets the component of its own text. A null id never names a
component. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm import wordhash as W
from custvalue.llm.components import components
from custvalue.llm.shared import Scratch, give_back, named, saved, small_batches, text_parts
from custvalue.llm.substrings import _planes, _unplaned

SHINGLE = 5
THRESHOLD = 80  # percent
PART_BYTES = 4 << 20  # text bytes whose index entries make one group
SAMPLE_DOCS = 20_000  # and at least one in 8: documents looked at for crowded segments
CROWDED = 32  # sets that make a segment crowded, as estimated from the sample
PAIRED = 64  # members, at most, of an entry whose members are paired
BLOCK = 700  # members of a family's block
MOST_CROWDED = 500_000  # broadcast at most so many; the rest are treated like others
FILTER_BITS = 26  # at most 2**26 bits of filter are broadcast; more ids only make it coarser

_TOP = 40
_DELETED = np.uint64(0x6C62272E07BB0142)
_TOKEN = np.uint64(0x27D4EB2F165667C5)


@dataclass(frozen=True)
class Scheme:
    """Size bands, segments per band, and bounds for a threshold in percent."""

    threshold: int = THRESHOLD
    tops: np.ndarray = field(init=False)
    segments: np.ndarray = field(init=False)

    def __post_init__(self):
        tops = [3, 7, 11, 15] + [(16 << k) - 1 for k in range(1, _TOP)]
        object.__setattr__(self, "tops", np.array(tops, np.int64))
        most = self.differing(self.tops)
        few = -(-(most + 1) // 2)
        many = most + most // 8 + 4
        segments = np.where(self.tops < 16, few, many)
        object.__setattr__(self, "segments", np.maximum(segments, 1))

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return n * 100 // self.threshold

    def differing(self, n: np.ndarray) -> np.ndarray:
        """Shingles, at most, in which a set of size n differs from any partner."""
        return (n + self.largest_partner(n)) * (100 - self.threshold) // (100 + self.threshold)

    def bands(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their band): own bands first, then the next higher ones."""
        band = np.searchsorted(self.tops, n)
        mine = np.ones(len(n), bool)
        while mine.any():
            yield mine, band
            mine = mine & (self.tops[band] + 1 <= self.largest_partner(n))
            band = band + mine


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their edges."""
    w = W.words(W.LOWER[data], offsets)
    runs = W.runs(w.hashes, [1, 2, 3, 4, SHINGLE])
    sets = []
    for low, n in zip(w.first[:-1].tolist(), w.counts.tolist()):
        if n >= SHINGLE:
            sets.append(np.unique(runs[SHINGLE][low : low + n - SHINGLE + 1]))
        else:
            sets.append(runs[n][low : low + 1] if n else np.empty(0, np.uint64))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), edges


def class_hashes(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One number per set; equal sets have equal numbers. 0 for empty sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(flat ^ _TOKEN))])
    n = np.diff(edges)
    return np.where(n > 0, W.mixed(np.diff(sums[edges]) + n.astype(np.uint64)), np.uint64(0))


def sketches(flat: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Counts of each set's shingles by hash, one byte each, about four shingles to a count."""
    bucket = W.mixed(flat + np.uint64(17))
    out = []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        size = max(16, 1 << ((high - low) // 4).bit_length())
        count = np.bincount(bucket[low:high] & np.uint64(size - 1), minlength=size)
        out.append(np.minimum(count, 255).astype(np.uint8).tobytes())
    return out


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles, at least, that lie in one set alone, by their sketches."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    if len(a) != len(b):
        if (a == 255).any():  # a count that may be larger cannot be added up
            return 0
        a = a.reshape(-1, len(b)).sum(axis=0, dtype=np.int64)
        a = np.where(b == 255, np.minimum(a, 255), a)
    return int(np.abs(a.astype(np.int64) - b).sum())


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[spot] == values


def _rank(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The running count of flags within each owner (owners lie in order)."""
    total = np.cumsum(flags)
    base = np.concatenate([[0], np.cumsum(np.bincount(owner, flags, n).astype(np.int64))])
    return total - base[owner]


def signatures(
    flat: np.ndarray, edges: np.ndarray, scheme: Scheme, crowded: np.ndarray, all_: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, is crowded): the index entries of each set. Sets are not empty.

    ``all_`` gives the entries of all segments, for a look at which are crowded.
    """
    n = np.diff(edges)
    owner = np.repeat(np.arange(len(n)), n)
    bound = scheme.differing(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    special: list[tuple[np.ndarray, np.ndarray]] = []  # entries that are never passed over
    for mine, band in scheme.bands(n):
        token = mine[owner]
        who = owner[token]
        salt = W.mixed(band.astype(np.uint64) + np.uint64(101))
        h = W.mixed(flat[token] + salt[who])
        count = scheme.segments[band]
        part = ((h >> np.uint64(32)) * count[who].astype(np.uint64)) >> np.uint64(32)
        value = W.mixed(h ^ _TOKEN)
        order = np.argsort((who.astype(np.uint64) << np.uint64(32)) | part, kind="stable")
        who, part, value = who[order], part[order], value[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        seg_who, seg_part = who[first], part[first]
        seg_salt = W.mixed(seg_part * _TOKEN + salt[seg_who])
        total = np.add.reduceat(value, first)
        exact = W.mixed(total + seg_salt)
        size = np.diff(np.append(first, len(who)))
        hot = _within(exact, crowded)
        need = bound + 1
        filled = np.bincount(seg_who, minlength=len(n))
        cold_n = np.bincount(seg_who, ~hot, len(n)).astype(np.int64)
        enough = cold_n >= need
        few = mine & (filled < need)
        if all_:
            out.append((seg_who, exact))
        else:
            run = _rank(~hot, seg_who, len(n)) <= need[seg_who]
            every = _rank(np.ones(len(first), bool), seg_who, len(n)) <= need[seg_who]
            take = ~hot & (run | ~enough[seg_who])
            out.append((seg_who[take], exact[take]))
            take = hot & ~enough[seg_who] & (every | few[seg_who])
            special.append((seg_who[take], exact[take]))
        if not few.any():
            continue
        # Allocation 2: segments with their one-deletion neighbourhoods.
        reach = np.bincount(seg_who, np.minimum(size, 2), len(n)).astype(np.int64)
        short = few & (reach < need)
        seg = np.cumsum(new) - 1
        here = few[seg_who]
        special.append((seg_who[here], W.mixed(exact[here] ^ _DELETED)))
        rest = few[who] & ((size[seg] > 1) | short[who])
        less = W.mixed(total[seg[rest]] - value[rest] + seg_salt[seg[rest]])
        special.append((who[rest], W.mixed(less ^ _DELETED)))
        for x in np.flatnonzero(short):
            gone = np.setdiff1d(np.arange(count[x], dtype=np.uint64), seg_part[seg_who == x])
            empty = W.mixed(W.mixed(gone * _TOKEN + salt[x]))
            special.append((np.full(len(gone), x), W.mixed(empty ^ _DELETED)))
    both = [*out, *special]
    who = np.concatenate([w for w, _ in both]) if both else np.empty(0, np.int64)
    entry = np.concatenate([e for _, e in both]) if both else np.empty(0, np.uint64)
    return who, entry, _within(entry, crowded)


_INDEX = (
    "n long, node long, entry long, part long, entries binary, nodes binary, sizes binary, "
    "place binary, sketch binary"
)


def _once(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sets of a batch that are not empty, their edges, and their hashes."""
    node = class_hashes(flat, edges)
    once = np.unique(node, return_index=True)[1]
    once = once[np.diff(edges)[once] > 0]
    sets = [flat[edges[i] : edges[i + 1]] for i in once.tolist()]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([np.empty(0, np.uint64), *sets]), bounds, node[once]


def _empty_columns(rows: int) -> dict[str, pa.Array]:
    longs = {k: pa.nulls(rows, pa.int64()) for k in ("n", "node", "entry", "part")}
    binaries = ("entries", "nodes", "sizes", "place", "sketch")
    return longs | {k: pa.nulls(rows, pa.binary()) for k in binaries}


def _indexed(scheme: Scheme, crowded: np.ndarray, parts: int):
    """Rows of three kinds: documents (n is set), groups of index entries (part is set) and
    crowded entries (entry is set)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column(1)):
                flat, edges = shingle_sets(data, offsets)
                node = class_hashes(flat, edges)
                n = np.diff(edges)
                ids = batch.column(0).slice(low, high - low)
                columns = _empty_columns(len(n))
                columns["n"] = pa.array(n)
                columns["node"] = pa.array(node.view(np.int64), mask=n == 0)
                columns["sketch"] = pa.array(sketches(flat, edges), pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": ids} | columns)
                yield from entries(flat, edges, ids.type)

    def entries(flat, edges, id_type):
        flat, edges, node = _once(flat, edges)
        n = np.diff(edges)
        who, entry, hot = signatures(flat, edges, scheme, crowded)
        if hot.any():
            columns = _empty_columns(int(hot.sum()))
            columns["entry"] = pa.array(entry[hot].view(np.int64))
            columns["node"] = pa.array(node[who[hot]].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(hot.sum(), id_type)} | columns)
        who, entry = who[~hot], entry[~hot]
        part = (W.mixed(entry) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((who, part))
        who, entry, part = who[order], entry[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        rows = []
        for p in full.tolist():
            mine = slice(cuts[p], cuts[p + 1])
            used, place = np.unique(who[mine], return_inverse=True)
            rows.append(
                (
                    entry[mine].tobytes(), node[used].tobytes(), _planes(n[used], "<u4"),
                    _planes(place, "<u4"),
                )
            )
        columns = _empty_columns(len(full))
        columns["part"] = pa.array(full)
        for i, name in enumerate(("entries", "nodes", "sizes", "place")):
            columns[name] = pa.array([r[i] for r in rows], pa.binary())
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(full), id_type)} | columns)

    return index


def _all_entries(scheme: Scheme):
    nothing = np.empty(0, np.uint64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_parts(batch.column(1)):
                flat, bounds, node = _once(*shingle_sets(data, offsets))
                who, entry, _ = signatures(flat, bounds, scheme, nothing, all_=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "entry": pa.array(entry.view(np.int64)),
                        "node": pa.array(node[who].view(np.int64)),
                    }
                )

    return look


def crowded_entries(
    texts: DataFrame, n_docs: int, scheme: Scheme, members: int = CROWDED
) -> np.ndarray:
    """Sorted index entries that many different sets share, by a sample of documents."""
    share = min(1.0, max(SAMPLE_DOCS / max(n_docs, 1), 1 / 8))
    limit = max(4, round(members * share))
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    sample = texts.where(place < int(share * (1 << 20)) + 1)
    found = (
        sample.mapInArrow(_all_entries(scheme), "entry long, node long")
        .groupBy("entry")
        .agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where((F.col("n") >= limit) & (F.col("low") < F.col("high")))
        .orderBy(F.desc("n"), "entry")
        .limit(MOST_CROWDED)
        .select("entry")
        .collect()
    )
    return np.sort(np.array([row.entry for row in found], np.int64).view(np.uint64))


def _met(threshold: int, paired: int = PAIRED):
    """Of a group's entries: pairs of members (a, b), or the members (x) of crowded ones."""

    def meet(group: pa.Table) -> pa.Table:
        entries, nodes, sizes = [], [], []
        for row in group.select(["entries", "nodes", "sizes", "place"]).to_pylist():
            place = _unplaned(row["place"], "<u4")
            entries.append(np.frombuffer(row["entries"], np.uint64))
            nodes.append(np.frombuffer(row["nodes"], np.int64)[place])
            sizes.append(_unplaned(row["sizes"], "<u4").astype(np.int64)[place])
        entry, node, n = map(np.concatenate, (entries, nodes, sizes))
        several = np.flatnonzero(W.repeated(entry))
        order = several[np.lexsort((node[several], entry[several]))]
        entry, node, n = entry[order], node[order], n[order]
        new = np.ones(len(entry), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])
        entry, node, n = entry[new], node[new], n[new]
        start = np.ones(len(entry), bool)
        start[1:] = entry[1:] != entry[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(entry)))
        many = np.repeat(size > paired, size)
        # Pairs by distance in their entry: next neighbours, next but one, and so on.
        few = np.flatnonzero(~many)
        e, x, k = entry[few], node[few], n[few]
        found = []
        for step in range(1, min(paired, len(e))):
            same = np.flatnonzero(e[step:] == e[:-step])
            if not len(same):
                break
            a, b, na, nb = x[same], x[same + step], k[same], k[same + step]
            fits = 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
            found.append(np.stack([a[fits], b[fits]], axis=1))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
        code = W.mixed(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)
        pairs = pairs[np.unique(code, return_index=True)[1]]
        none = np.zeros(len(pairs) + int(many.sum()), bool)
        none[len(pairs) :] = True
        filler = np.zeros(int(many.sum()), np.int64)
        give_back()
        return pa.table(
            {
                "a": pa.array(np.concatenate([pairs[:, 0], node[many]])),
                "b": pa.array(np.concatenate([pairs[:, 1], filler]), mask=none),
                "bucket": pa.array(
                    np.concatenate([np.zeros(len(pairs), np.int64), entry[many].view(np.int64)]),
                    mask=~none,
                ),
            }
        )

    return meet


def _may_link(threshold: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            bound = n * (100 - threshold) // (100 + threshold)
            keep = [
                least_difference(x.as_buffer(), y.as_buffer()) <= most
                for x, y, most in zip(batch.column(4), batch.column(5), bound.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return check


def _not_ruled_out(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sketches leave it open whether they link."""
    mine = sets.select(
        F.col("node").alias("__a"), F.col("n").alias("na"), F.col("sketch").alias("x")
    )
    theirs = sets.select(
        F.col("node").alias("__b"), F.col("n").alias("nb"), F.col("sketch").alias("y")
    )
    both = pairs.join(mine, F.struct("a") == F.struct("__a"))
    both = both.join(theirs, F.struct("b") == F.struct("__b"))
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(
        _may_link(threshold), "a long, b long"
    )


def _families(apart: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, family): members tied together by crowded entries (bucket, x)."""
    ends = apart.groupBy("bucket").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = ends.where("low <> high").withColumnRenamed("bucket", "__bucket")
    met = apart.join(ends, F.struct("bucket") == F.struct("__bucket"))
    ties = scratch.saved(met.where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")))
    return components(ties).withColumnRenamed("component", "family")


def _cell_links(threshold: int):
    """Per member of a cell its smallest member that links reach within the cell."""

    def link(cell: pa.Table) -> pa.Table:
        node = cell.column("node").to_numpy()
        once = np.unique(node, return_index=True)[1]
        node = node[once]
        column = cell.column("shingles").combine_chunks()
        sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in once.tolist()]
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        flat = np.concatenate(sets)
        shared = W.repeated(flat)
        owner, flat = owner[shared], np.unique(flat[shared], return_inverse=True)[1]
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        for low in range(0, int(flat[-1]) + 1 if len(flat) else 0, width):
            part = slice(*np.searchsorted(flat, (low, low + width)))
            holds = np.zeros((len(sets), width), np.float32)
            holds[owner[part], flat[part] - low] = 1
            common += holds @ holds.T
        linked = 100 * common >= threshold * (n[:, None] + n[None, :] - common)
        label = np.arange(len(sets), dtype=np.int32)
        while True:
            least = np.where(linked, label[None, :], np.int32(len(sets))).min(axis=1)
            least = np.minimum(least, label)
            least = least[least]
            if (least == label).all():
                break
            label = least
        far = np.flatnonzero(label != np.arange(len(sets)))
        give_back()
        return pa.table({"a": pa.array(node[far]), "b": pa.array(node[label[far]])})

    return link


def _family_links(
    families: DataFrame, sets: DataFrame, threshold: int, block: int = BLOCK
) -> DataFrame:
    """Links within families, as pairs of members that links join."""
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    sizes = sizes.withColumnRenamed("family", "__family")
    blocks = F.ceil(F.col("size") / block).cast("long")
    placed = families.join(sizes, F.struct("family") == F.struct("__family")).select(
        F.col("node").alias("__node"), "family",
        F.pmod(F.xxhash64("node"), blocks).alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"),
    )
    cells = placed.select(
        "__node", "family",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )
    whole = cells.join(sets, F.struct("__node") == F.struct("node"))
    return whole.select("family", "i", "j", "node", "shingles").groupBy(
        "family", "i", "j"
    ).applyInArrow(_cell_links(threshold), "a long, b long")


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit table of hashed ids (column id), of bounded size."""
    n = ids.count()
    bits = min(FILTER_BITS, max(10, int(n * 16).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = (
        ids.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    for row in words:
        table[row.word] = row.bits
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _sets_of(texts: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the documents with these ids, and of a few others."""
    wanted = _filter_bits(ids)
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    size = len(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value, count=size).astype(bool)
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            some = batch.column(1).filter(pa.array(known[place]))
            for _, _, data, offsets in text_parts(some):
                flat, edges, node = _once(*shingle_sets(data, offsets))
                spans = zip(edges[:-1].tolist(), edges[1:].tolist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(node.view(np.int64)),
                        "shingles": pa.array([flat[a:b].tobytes() for a, b in spans], pa.binary()),
                    }
                )

    place = F.pmod(F.xxhash64("id"), F.lit(size)).alias("place")
    return scratch.saved(
        texts.select(place, "text").mapInArrow(read, "node long, shingles binary")
    )


def _linked(threshold: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(mine.as_buffer(), np.uint64)
                y = np.frombuffer(theirs.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[spot] == x).sum())
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return check


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    mine = sets.select(F.col("node").alias("__a"), F.col("shingles").alias("x"))
    theirs = sets.select(F.col("node").alias("__b"), F.col("shingles").alias("y"))
    both = pairs.join(mine, F.struct("a") == F.struct("__a")).drop("__a")
    both = both.join(theirs, F.struct("b") == F.struct("__b"))
    return both.select("a", "b", "x", "y").mapInArrow(_linked(threshold), "a long, b long")


def similar_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: int = THRESHOLD,
    members: int = CROWDED,
    paired: int = PAIRED,
    block: int = BLOCK,
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id that links reach.

    ``members``, ``paired`` and ``block`` set what is crowded, up to where members of an entry
    are paired, and how large a family's blocks are; no result depends on them.
    """
    texts = docs.select(named(id_column).alias("id"), named(text_column).alias("text"))
    texts = small_batches(texts)
    scheme, scratch = Scheme(threshold), Scratch()
    size = texts.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    parts = max(1, -(-(size["bytes"] or 0) // PART_BYTES))
    crowded = crowded_entries(texts, size["n"], scheme, members)
    kind = texts.schema["id"].dataType.simpleString()
    index = scratch.saved(
        texts.mapInArrow(_indexed(scheme, crowded, parts), f"doc_id {kind}, {_INDEX}")
    )
    rows = index.where("n IS NOT NULL").select("doc_id", "n", "node")
    kinds = index.where("n IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("id")
    )
    kinds = scratch.saved(kinds)
    met = scratch.saved(
        index.where("part IS NOT NULL")
        .select("part", "entries", "nodes", "sizes", "place")
        .groupBy("part")
        .applyInArrow(_met(threshold, paired), "a long, b long, bucket long")
    )
    pairs = met.where("b IS NOT NULL").select("a", "b").distinct()
    pairs = scratch.saved(_not_ruled_out(pairs, kinds, threshold))
    apart = index.where("entry IS NOT NULL").select("entry", "node")
    apart = apart.union(met.where("bucket IS NOT NULL").select("bucket", "a"))
    families = _families(scratch.saved(apart.toDF("bucket", "x").distinct()), scratch)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("__node"))
    asked = asked.union(families.select("node")).distinct()
    sets = _sets_of(texts, kinds.join(asked, F.struct("node") == F.struct("__node")).select("id"), scratch)
    links = _verified(pairs, sets, threshold)
    links = links.union(_family_links(families, sets, threshold, block))
    found = components(links)
    named_ = _named_components(rows, found)
    scratch.clear()  # the result reads one stored table of its own
    return named_


def _named_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    labelled = saved(
        rows.join(found, F.struct("node") == F.struct("__node"), "left").select(
            "doc_id", "n", F.coalesce("__component", "node").alias("label")
        )
    )
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    least = least.withColumnRenamed("label", "__label")
    return labelled.join(least, F.struct("label") == F.struct("__label"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
    )
