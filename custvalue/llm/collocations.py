"""Phrase collocations by relational (SETM) mining.

The occurrences of the phrases of one length are a stored relation, sorted by place: a block holds
the places of many pieces of text, numbered so that places one apart are neighbours in one piece.
Merging the relation with itself one place on gives the occurrences of the phrases one word longer;
these are grouped and counted, and only occurrences of frequent groups are stored for the next
length. A phrase is known by the numbers of the two phrases one word shorter that it starts and
ends with, so counts are exact and no text is hashed.

The frequent groups of a length go to every task in lists of about ``BROADCAST_ROWS``, of which a
task holds one at a time. Beyond ``_LISTS`` of them occurrences find theirs by a join, with the same
result; a join sends every different pair of a block.

Defined results: a null text is empty; an empty text, or one of marks alone, has no words. A null
language is ``und``. Repeated rows count as often as they stand there. Ties in score and count go
by phrase in byte order. An empty table gives an empty table. Other columns are not read, whatever
their names. A piece may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm.shared import Scratch, give_back, named, saved, small_batches, text_parts
from custvalue.llm.wordhash import LOWER

LEAST = 100
MOST_WORDS = 5
FIRST = 2000
BROADCAST_ROWS = 1 << 18
_LISTS = 64
_RANKED_TOGETHER = 50_000
_COUNTED_TOGETHER = 8_000_000  # occurrences a task counts before it gives counts away
_HELD_PAIRS = 1 << 21  # pairs of neighbours that a task holds before it adds up equal ones
_ADDED_TOGETHER = 1 << 21  # counts, at most about, that one group adds up
_BLOCK_BYTES = 1 << 20  # of text; a longer text is a block of its own

# Bytes between words, and bytes that end a piece.
_BLANK = np.isin(np.arange(256), [32, 9])
_END = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
_BETWEEN = _BLANK | _END

_RELATION = "block long, step binary, item binary"


def _packed(block: int, place: np.ndarray, item: np.ndarray) -> dict:
    """A block of a relation. Places are stored as steps, which are small, items in as few bytes
    as the largest takes."""
    return {
        "block": block,
        "step": np.diff(place, prepend=0).astype("<i4").tobytes(),
        "item": item.astype(np.min_scalar_type(item.max(initial=0)).newbyteorder("<")).tobytes(),
    }


def _unpacked(step: bytes, item: bytes) -> tuple[np.ndarray, np.ndarray]:
    place = np.cumsum(np.frombuffer(step, "<i4"), dtype=np.int64)
    kind = f"<u{len(item) // max(len(place), 1) or 1}"
    return place, np.frombuffer(item, kind).astype(np.int64)


def _placed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of the text, place, and word of every occurrence."""
    inside = ~_BETWEEN[data]
    joined = inside[1:] & inside[:-1]
    breaks = offsets[(offsets > 0) & (offsets < len(data))]
    joined[breaks - 1] = False
    opening, closing = inside.copy(), inside.copy()
    opening[1:] &= ~joined
    closing[:-1] &= ~joined
    starts, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    marks = np.concatenate([[0], np.cumsum(_END[data])])
    apart = np.zeros(len(starts), np.int64)
    apart[1:] = (marks[starts[1:]] > marks[ends[:-1]]) | (owner[1:] != owner[:-1])
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(LOWER[data[inside]])
    )
    return owner, np.arange(len(starts)) + np.cumsum(apart), words


_WORDS = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("words", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
        ("n", pa.int64()),
        ("step", pa.binary()),
        ("item", pa.binary()),
    ]
)


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        kind = langs.indices.to_numpy(zero_copy_only=False)
        for low, high, data, offsets in text_parts(batch.column(1), _BLOCK_BYTES):
            owner, place, words = _placed(data, offsets)
            lang = kind[low:high][owner]
            for one in np.unique(lang).tolist():
                here = np.flatnonzero(lang == one)
                coded = words.take(pa.array(here)).dictionary_encode()
                item = coded.indices.to_numpy(zero_copy_only=False)
                row = _packed(block, place[here], item) | {
                    "lang": langs.dictionary[one].as_py(),
                    "words": coded.dictionary.cast(pa.string()),
                    "counts": np.bincount(item, minlength=len(coded.dictionary)),
                    "n": len(item),
                }
                yield pa.RecordBatch.from_arrays(
                    [_single(row[f.name], f.type) for f in _WORDS], schema=_WORDS
                )
                block += 1


def _single(value, kind: pa.DataType) -> pa.Array:
    """An array of one value; a list comes as an array already."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rows(blocks: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.int64()), ("step", pa.binary()), ("item", pa.binary())])
    return pa.RecordBatch.from_pylist(blocks, schema=schema)


class _Neighbours:
    """A relation's block merged with itself one place on: which two items stand together."""

    def __init__(self, step: bytes, item: bytes):
        place, item = _unpacked(step, item)
        at = np.flatnonzero(np.diff(place) == 1)
        self.place = place[at]
        first, x = np.unique(item[at], return_inverse=True)
        second, y = np.unique(item[at + 1], return_inverse=True)
        pair, self.of, self.n = np.unique(
            x * max(len(second), 1) + y, return_inverse=True, return_counts=True
        )
        x, y = np.divmod(pair, max(len(second), 1))
        self.first, self.second = first[x], second[y]

    def kept(self, block: int, item: np.ndarray) -> list[dict]:
        """The block of the next relation; ``item`` numbers each pair, -1 where it goes."""
        found = item[self.of]
        there = found >= 0
        return [_packed(block, self.place[there], found[there])] if there.any() else []


class _Lookup:
    """Numbers of pairs, -1 where a pair is not listed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, number: np.ndarray):
        self.x, at_x = np.unique(x, return_inverse=True)
        self.y, at_y = np.unique(y, return_inverse=True)
        key = at_x * max(len(self.y), 1) + at_y
        order = np.argsort(key)
        self.key, self.number = key[order], number[order]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(x), -1)
        at_x, in_x = _at(self.x, x)
        at_y, in_y = _at(self.y, y)
        at, there = _at(self.key, at_x * len(self.y) + at_y)
        return np.where(in_x & in_y & there, self.number[at], -1)


class _Sent:
    """Lists that go to every task. A task goes through them again and again and, of several, holds
    one at a time; so does the driver that sends them."""

    def __init__(self, spark, lists: Iterator):
        self.lists = [spark.sparkContext.broadcast(one) for one in lists]

    def __iter__(self) -> Iterator:
        for one in self.lists:
            yield one.value
            if len(self.lists) > 1:
                vars(one).pop("_value", None)


def _lists(number: int, rows: int) -> int:
    """How many lists ``number`` frequent groups go to the tasks in; 0 if a join finds them."""
    count = -(-max(number, 1) // rows) if rows else 0
    return count if count <= _LISTS else 0


def _at(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


class _PairCodes:
    """Pairs of ``items`` numbers as one number each, in order of the part they are dealt to. Sums
    deal them: the many pairs of a frequent item are spread over all parts."""

    def __init__(self, items: int, parts: int):
        self.items, self.parts, self.width = items, parts, -(-items // parts)
        if parts * items * self.width >= 1 << 63:
            raise ValueError(f"pairs of {items} phrases do not fit 64 bits")

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x + y) % self.parts * self.items + x) * self.width + y // self.parts

    def split(self, pair: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Each part of ordered pairs, and their numbers in it."""
        part, inside = np.divmod(pair, self.items * self.width)
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for low, high in zip(edges, edges[1:]):
            yield int(part[low]), slice(low, high), inside[low:high]

    def pairs(self, part: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.divmod(inside, self.width)
        return x, y * self.parts + (part - x) % self.parts


def _added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order with the sums of their counts."""
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _bytewise(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, as many as the largest value takes."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_bytewise(data: bytes, size: int) -> np.ndarray:
    whole = np.zeros((size, 8), np.uint8)
    there = np.frombuffer(data, np.uint8).reshape(-1, size)
    whole[:, : len(there)] = there.T
    return whole.view("<i8").ravel()


def _pair_counts(codes: _PairCodes):
    def packed(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = [
            (part, len(inside), _bytewise(np.diff(inside, prepend=0)), _bytewise(n[some]))
            for part, some, inside in codes.split(pair)
        ]
        names = ("part", "size", "step", "n")
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0
        for batch in batches:
            for step, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                near = _Neighbours(step, item)
                pairs.append(codes.of(near.first, near.second))
                counts.append(near.n)
                held += len(near.n)
                if held < _HELD_PAIRS:
                    continue
                pair, n = _added(np.concatenate(pairs), np.concatenate(counts))
                pairs, counts, held = [pair], [n], len(n)
                if held > _HELD_PAIRS // 2:
                    yield packed(pair, n)
                    pairs, counts, held = [], [], 0
            give_back()
        if held:
            yield packed(*_added(np.concatenate(pairs), np.concatenate(counts)))

    return count


def _frequent_pairs(
    relation: DataFrame, items: int, occurrences: int, tasks: int, least: int
) -> DataFrame:
    """The pairs of neighbours that occur at least ``least`` times: x, y, f.

    Tasks add up what they count, and send one row per part: ordered pairs as steps, and counts.
    """
    codes = _PairCodes(max(items, 1), -(-occurrences // _ADDED_TOGETHER) or 1)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        part, sizes = key[0].as_py(), rows.column("size").to_pylist()
        steps, counts = rows.column("step").to_pylist(), rows.column("n").to_pylist()
        inside, n = _added(
            np.concatenate([np.cumsum(_from_bytewise(*one)) for one in zip(steps, sizes)]),
            np.concatenate([_from_bytewise(*one) for one in zip(counts, sizes)]),
        )
        often = n >= least
        x, y = codes.pairs(part, inside[often])
        give_back()
        return pa.table({"x": x, "y": y, "f": n[often]})

    counted = small_batches(relation.select("step", "item").coalesce(tasks)).mapInArrow(
        _pair_counts(codes), "part long, size long, step binary, n binary"
    )
    return counted.groupBy("part").applyInArrow(add, "x long, y long, f long")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, stored, with an ``id`` from 0 without gaps."""
    rows = saved(rows.select(F.monotonically_increasing_id().alias("id"), "*"))
    part = F.shiftright("id", 33)
    before, starts = 0, []
    for row in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts += [F.lit(row["part"]), F.lit(before - (row["part"] << 33))]
        before += row["count"]
    shift = F.create_map(*starts)[part] if starts else F.lit(0)
    return rows.withColumn("id", F.col("id") + shift)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, step, item in zip(*(c.to_pylist() for c in batch.columns)):
            near = _Neighbours(step, item)
            yield pa.RecordBatch.from_pydict(
                {"block": np.full(len(near.n), block), "x": near.first, "y": near.second}
            )


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _longer(relation: DataFrame, frequent: DataFrame, lists: int) -> DataFrame:
    """The occurrences of the frequent pairs (id, x, y) of neighbours in ``relation``."""
    if lists:

        def listed() -> Iterator[_Lookup]:
            for k in range(lists):
                here = F.pmod(F.col("x") + F.col("y"), F.lit(lists)) == k
                some = frequent.where(here).select("x", "y", "id").toArrow()
                yield _Lookup(*(_numbers(some, name) for name in ("x", "y", "id")))

        sent = _Sent(frequent.sparkSession, listed())

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = [_Neighbours(*one) for one in zip(*(c.to_pylist() for c in batch.columns[1:]))]
                x, y = (np.concatenate([getattr(n, name) for n in near]) for name in ("first", "second"))
                of, number = (x + y) % lists, np.full(len(x), -1)
                for k, lookup in enumerate(sent):
                    here = np.flatnonzero(of == k)
                    number[here] = lookup(x[here], y[here])
                ends = np.cumsum([len(n.n) for n in near])[:-1]
                for block, n, item in zip(batch.column(0).to_pylist(), near, np.split(number, ends)):
                    yield _rows(n.kept(block, item))
                del near, x, y, of, number
                give_back()

        return small_batches(relation).mapInArrow(extend, _RELATION)

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        near = _Neighbours(left.column("step")[0].as_py(), left.column("item")[0].as_py())
        lookup = _Lookup(*(_numbers(right, name) for name in ("x", "y", "id")))
        rows = near.kept(key[0].as_py(), lookup(near.first, near.second))
        return pa.Table.from_batches([_rows(rows)])

    pairs = small_batches(relation).mapInArrow(_block_pairs, "block long, x long, y long")
    own = pairs.join(frequent.select("x", "y", "id"), ["x", "y"])
    return _by_block(relation, own, join)


def _by_block(blocks: DataFrame, own: DataFrame, join) -> DataFrame:
    """``join`` of each block with its rows of ``own``; blocks without any go."""
    blocks = blocks.withColumnRenamed("block", "of")
    there = own.select(F.col("block").alias("of")).distinct()
    both = blocks.join(there, "of", "left_semi").groupBy("of").cogroup(own.groupBy("block"))
    return both.applyInArrow(join, _RELATION)


def _frequent_words(blocks: DataFrame, words: DataFrame, lists: int) -> DataFrame:
    """The occurrences of the frequent words (id, lang, word) in blocks of words by their own
    numbers."""

    def kept(block: int, step: bytes, item: bytes, number: np.ndarray) -> list[dict]:
        place, item = _unpacked(step, item)
        found = number[item]
        there = found >= 0
        return [_packed(block, place[there], found[there])] if there.any() else []

    if lists:

        def listed() -> Iterator[dict]:
            for k in range(lists):
                some = words.where(F.pmod("id", F.lit(lists)) == k).select("lang", "word", "id")
                some = some.toArrow().combine_chunks()
                yield {
                    lang: (rows.column("word").combine_chunks(), _numbers(rows, "id"))
                    for lang in some.column("lang").unique().to_pylist()
                    for rows in [some.filter(pc.equal(some.column("lang"), lang))]
                }

        sent = _Sent(words.sparkSession, listed())

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = batch.column(1).dictionary_encode()
                langs, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                own = [batch.column(2).take(pa.array(np.flatnonzero(of == i))) for i in range(len(langs))]
                number = [np.full(len(texts.flatten()), -1) for texts in own]
                for one in sent:
                    for lang, texts, found in zip(langs, own, number):
                        if lang in one:
                            names, ids = one[lang]
                            at = pc.index_in(texts.flatten().cast(names.type), value_set=names)
                            at = at.fill_null(-1).to_numpy(zero_copy_only=False)
                            found[at >= 0] = ids[at[at >= 0]]
                for i, (texts, found) in enumerate(zip(own, number)):
                    ends = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))[:-1]
                    for row, here in zip(np.flatnonzero(of == i).tolist(), np.split(found, ends)):
                        block, step, item = (batch.column(c)[row].as_py() for c in (0, 3, 4))
                        yield _rows(kept(block, step, item, here))
                give_back()

        read = blocks.select("block", "lang", "words", "step", "item")
        return small_batches(read).mapInArrow(find, _RELATION)

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        step, item = (left.column(name)[0].as_py() for name in ("step", "item"))
        number = np.full(left.column("size")[0].as_py(), -1)
        number[_numbers(right, "at")] = _numbers(right, "id")
        return pa.Table.from_batches([_rows(kept(key[0].as_py(), step, item, number))])

    own = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    own = own.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "at", "id")
    sized = blocks.select("block", F.size("words").alias("size"), "step", "item")
    return _by_block(sized, own, join)


def _with_parts(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases from their first and last part: words, count, and the counts of all heads and tails
    (of one word, of two, and so on)."""
    x = shorter.select(
        F.col("id").alias("x"), "lang", F.col("words").alias("start"), "heads", F.col("f").alias("fx")
    )
    y = shorter.select(
        F.col("id").alias("y"), F.element_at("words", -1).alias("last"), "tails",
        F.col("f").alias("fy"),
    )
    return pairs.join(x, "x").join(y, "y").select(
        "id", "lang", F.concat("start", F.array("last")).alias("words"), "f",
        F.concat("heads", F.array("fx")).alias("heads"),
        F.concat("tails", F.array("fy")).alias("tails"),
    )


def _score(size: int) -> Column:
    """The lowest-scoring cut of a phrase of ``size`` words: score, k, l, r. Exact: decimals of 38
    digits hold the products of counts up to 3 * 10**17."""
    whole = "cast(f AS decimal(19, 0)) * cast(n AS decimal(19, 0)) * cast(1000 AS decimal(4, 0))"
    cuts = []
    for k in range(1, size):
        left, right = f"heads[{k - 1}]", f"tails[{size - k - 1}]"
        parts = f"cast({left} AS decimal(19, 0)) * cast({right} AS decimal(19, 0))"
        cuts.append(
            F.struct(
                F.expr(f"({whole}) div ({parts})").alias("score"), F.lit(k).alias("k"),
                F.expr(left).alias("l"), F.expr(right).alias("r"),
            )
        )
    return F.array_min(F.array(*cuts))


def _first_of(scored: DataFrame, first: int) -> DataFrame:
    """Each language's first rows. Ranked in parts first, so that no task sees a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    together = max(_RANKED_TOGETHER, 2 * first)

    def largest() -> int:
        sizes = scored.groupBy("lang").agg(F.count("*").alias("rows"))
        return sizes.agg(F.max("rows")).first()[0] or 0

    while (rows := largest()) > together:
        part = F.pmod(F.xxhash64("phrase"), F.lit(-(-rows // together)))
        nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        scored = scored.withColumn("part", part).withColumn("nth", nth)
        scored = saved(scored.where(F.col("nth") <= first).drop("part", "nth"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = scored.withColumn("rank", nth.cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[list[DataFrame], DataFrame]:
    """The phrases of 1, 2, ... words that occur at least ``least`` times (id, lang, words, f,
    heads, tails, and ``longer``: the largest count of a phrase one word longer that holds it), and
    the number of words per language (lang, n)."""
    scratch = Scratch()
    rows = docs.select(F.coalesce(named(lang_column), F.lit("und")), named(text_column))
    blocks = scratch.saved(
        small_batches(rows).mapInArrow(
            _word_blocks,
            "block long, lang string, words array<string>, counts array<long>, n long, "
            "step binary, item binary",
        ),
        "zstd",
    )
    totals = saved(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    # Rare groups shrink only where many occurrences of them meet, so a task counts many blocks.
    tasks = -(-(totals.agg(F.sum("n")).first()[0] or 0) // _COUNTED_TOGETHER) or 1
    each = blocks.coalesce(tasks).select(
        "lang", F.explode(F.arrays_zip("words", "counts")).alias("w")
    )
    words = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words = words.where(F.col("f") >= least)
    words = _numbered(words)
    none = F.array().cast("array<long>")
    level = words.select(
        "id", "lang", F.array("word").alias("words"), "f", none.alias("heads"), none.alias("tails")
    )
    number, occurrences = _size(words)
    relation = _frequent_words(blocks, words, _lists(number, broadcast_rows))
    levels = []
    for size in range(2, most_words + 1):
        relation = scratch.saved(relation, "zstd")
        frequent = _numbered(_frequent_pairs(relation, number, occurrences, tasks, least))
        levels.append(_held_by(level, frequent))
        number, occurrences = _size(frequent)
        level = saved(_with_parts(frequent, level))
        if not number:
            break
        if size < most_words:
            relation = _longer(relation, frequent, _lists(number, broadcast_rows))
    levels.append(level.withColumn("longer", F.lit(None).cast("long")))
    scratch.clear()
    return levels, totals


def _size(groups: DataFrame) -> tuple[int, int]:
    """How many groups there are, and how many occurrences of them."""
    return tuple(groups.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first())


def _held_by(level: DataFrame, longer: DataFrame) -> DataFrame:
    """``level`` with the largest count of a phrase that holds it. One word longer is enough: a
    phrase in between occurs at least as often as the longer one."""
    ends = longer.select(F.explode(F.array("x", "y")).alias("id"), "f")
    return level.join(ends.groupBy("id").agg(F.max("f").alias("longer")), "id", "left")


def collocations(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    first: int = FIRST,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each language's ``first`` phrases of two words or more by score: lang, rank, phrase, a
    (its count), l and r (counts of the parts of its lowest-scoring cut), n (words of the
    language), score = floor(1000 a n / (l r)).

    A phrase that a longer one holds and that occurs no more often is left out.
    """
    levels, totals = phrases(docs, lang_column, text_column, least, most_words, broadcast_rows)
    scored = []
    for size, level in enumerate(levels, 1):
        if size == 1:
            continue
        alone = level.where("longer IS NULL OR longer < f").join(totals, "lang")
        scored.append(
            alone.withColumn("cut", _score(size)).select(
                "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"),
                "cut.l", "cut.r", "n", "cut.score",
            )
        )
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    return _first_of(saved(every), first)
