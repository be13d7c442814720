"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, gets a virtual finish time: the source's words up
to and with it, divided by the source's weight. A source that is asked for more than it has goes
round again, as a further copy of each of its documents; one that has given all its rounds stops,
and the others share on by weight. Starts and finishes of all copies are sorted together, and
running totals over them give the words that all sources have given at any time: between two
events a line. The mix ends at the time when these are the budget. Which copies are in follows
from that time alone; a document in service then gives the words it has given by then, so no
source is off its target by more than rounding, however long its documents are.

The shuffle is a hash of the row, so reruns agree. The end is found in slices of time, the one that
holds it cut into slices again, so only sums of slices are compared. Running totals are taken over
slices of the order and within each slice, so no source, however large, meets in one task. Words
spread evenly over hash space and over virtual time, so slices of equal width are about equally
full.

Defined results: a null text has size 0 and is in the mix when its time has come (it takes no
words). Rows that repeat an id and text are documents of their own; their order among each other
is of no matter since they are equal. A null source is a source, sorted last. An empty table, or
one without words, mixes nothing. Input columns are kept; the result's own replace any of the
same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm.shared import WORD, named, saved

ROUNDS = 2  # a source gives each document at most so many times
MAX_SOURCES = 100_000  # one row each comes to the driver and is broadcast
_SLICE_ROWS = 1_000
_SLICES_PER_BLOCK = 1024
_TIME_SLICES = 1024


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(
    sizes: Sequence[int], weights: Sequence[float], budget: float, rounds: float = ROUNDS
) -> list[float]:
    """Targets by weight that stop at ``rounds`` times a size, the excess shared again by weight
    until no target is above."""
    targets, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > rounds * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(rounds * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return targets


def source_targets(
    sized: DataFrame, weights: Sequence[float], budget_share: float, rounds: int = ROUNDS
) -> DataFrame:
    """(source, source_no, source_rows, source_size, weight, target) from rows with ``source`` and ``size``: sources
    in order of code points, null last, take the weights in turn and share ``budget_share`` of
    all words."""
    rows = sized.groupBy("source").agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")
    )
    rows = rows.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to weigh")
    rows.sort(key=lambda r: (r["source"] is None, str(r["source"] or "").encode("utf-8")))
    sizes = [int(r["size"] or 0) for r in rows]
    turn = [weights[i % len(weights)] for i in range(len(rows))]
    targets = share_out(sizes, turn, budget_share * sum(sizes), rounds)
    kind = sized.select("source").schema[0].dataType.simpleString()
    return sized.sparkSession.createDataFrame(
        [
            (r["source"], i, r["rows"], s, float(w), t)
            for i, (r, s, w, t) in enumerate(zip(rows, sizes, turn, targets))
        ],
        f"source {kind}, source_no int, source_rows long, source_size long, weight double, "
        "target double",
    )


def total_before(
    rows: DataFrame,
    by: str,
    n_rows: Column,
    place: Column,
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows of ``by`` that come earlier.

    ``place``, from 0 to below 1, grows with the order and cuts it into slices, as many as the
    rows of ``by`` (``n_rows``) ask for, and runs of slices into blocks; each level adds what lies
    before it. The input is read twice.
    """
    slices = F.greatest(F.ceil(n_rows / _SLICE_ROWS), F.lit(1))
    at = F.least(F.floor(place * slices), slices - 1).cast("long")
    rows = rows.withColumn("__slice", at)
    sums = rows.groupBy(by, "__slice").agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__block", F.floor(F.col("__slice") / _SLICES_PER_BLOCK))
    before = (Window.unboundedPreceding, -1)

    def upto(column: str, *keys: str, order_by: Sequence[str]) -> Column:
        window = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(*before)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    blocks = sums.groupBy(by, "__block").agg(F.sum("__sum").alias("__total"))
    blocks = blocks.select(
        by, "__block", upto("__total", by, order_by=["__block"]).alias("__block_base")
    )
    bases = sums.withColumn("__base", upto("__sum", by, "__block", order_by=["__slice"]))
    bases = bases.join(blocks, [by, "__block"]).select(
        by, "__slice", (F.col("__base") + F.col("__block_base")).alias("__base")
    )
    inner = rows.withColumn(name, upto(value, by, "__slice", order_by=order))
    return (
        inner.join(bases, [by, "__slice"])
        .withColumn(name, F.col(name) + F.col("__base"))
        .drop("__slice", "__base")
    )


def end_of_mix(copies: DataFrame, budget: float) -> float | None:
    """The virtual time when the copies (``begin``, ``size``, ``weight``) have given ``budget``
    words together; None if they never do.

    A copy in service at time ``t`` has given ``weight * t - begin`` words and a finished one its
    size, so what all have given is ``t`` times the weights in service less their begins: both are
    running totals over starts and finishes in order of time.
    """
    given = copies.where("size > 0 AND weight > 0")
    end = F.col("begin") + F.col("size")
    starts = F.struct(
        (F.col("begin") / F.col("weight")).alias("time"), F.col("weight").alias("rate"),
        F.col("begin").alias("words"),
    )
    finishes = F.struct(
        (end / F.col("weight")).alias("time"), (-F.col("weight")).alias("rate"),
        (-end).alias("words"),
    )
    events = given.select(F.explode(F.array(starts, finishes)).alias("e")).select("e.*")
    first = events.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    low, high = first["low"], first["high"]
    if low is None:
        return None
    rate, words = 0.0, 0
    while True:
        width = max(high - low, 5e-324)
        at = F.least(F.floor((F.col("time") - low) / width * _TIME_SLICES), F.lit(_TIME_SLICES - 1))
        slices = (
            events.where(F.col("time").between(low, high))
            .groupBy(at.alias("slice"))
            .agg(
                F.min("time").alias("low"), F.max("time").alias("high"),
                F.sum("rate").alias("rate"), F.sum("words").alias("words"),
            )
            .orderBy("slice")
            .collect()
        )
        for s in slices:
            if rate > 0 and s["low"] * rate - words >= budget:
                return (budget + words) / rate
            if s["high"] * (rate + s["rate"]) - (words + s["words"]) >= budget:
                break
            rate, words = rate + s["rate"], words + s["words"]
        else:
            return None
        if s["low"] == s["high"]:
            return s["low"]
        low, high = s["low"], s["high"]


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    every = [named(c) for c in docs.columns]
    return docs.select(
        F.monotonically_increasing_id().alias("row"),  # fixed once the table is stored
        named(id_column).alias("id"),
        F.xxhash64(F.lit(11), *every).alias("key"),
        F.xxhash64(F.lit(12), *every).alias("key2"),
        named(source_column).alias("source"),
        n_words(named(text_column)).alias("size"),
    )


def schedule(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_share: float = 1.5,
    rounds: int = ROUNDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Every copy that may be in the mix, without its text: row (a number), id, key, key2, copy,
    size, source_size, target, virtual_finish, position (words of the mix before it) and ``words``,
    those the mix takes of it. Each document has its copy 0 here, with 0 words if it is not in.
    """
    sized = saved(_sized(docs, id_column, text_column, source_column))
    targets = source_targets(sized, weights, budget_share, rounds)
    budget = budget_share * int(targets.agg(F.sum("source_size")).first()[0] or 0)
    weighed = sized.withColumnRenamed("source", "__source").join(
        F.broadcast(targets), F.col("__source").eqNullSafe(F.col("source"))
    )
    shuffled = F.pmod("key", F.lit(1 << 40)) / float(1 << 40)
    weighed = weighed.select(*[c for c in weighed.columns if c not in ("__source", "source")])
    weighed = weighed.withColumn("__shuffled", shuffled)
    begun = total_before(
        weighed, "source_no", F.col("source_rows"), F.col("__shuffled"),
        ["__shuffled", "key", "key2", "row"], "size", "__start",
    )
    # Copy r of a document comes r rounds of its source later.
    rounds_of = begun.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    begin = F.col("__start") + F.col("copy") * F.col("source_size")
    copies = saved(
        rounds_of.select(
            "row", "id", "key", "key2", "copy", "size", "source_size", "weight", "target",
            begin.alias("begin"),
        )
    )
    end = end_of_mix(copies, budget)
    finish = F.when(
        F.col("weight") > 0, (F.col("begin") + F.col("size")) / F.col("weight")
    )
    if end is None:
        # All of it is in: time runs to the last finish.
        end = float(copies.agg(F.max(finish)).first()[0] or 0)
    by_end = F.round(F.col("weight") * F.lit(end) - F.col("begin"))
    given = F.greatest(F.least(F.col("size"), by_end), F.lit(0)).cast("long")
    offered = copies.select(
        "row", "id", "key", "key2", "copy", "size", "source_size", "target",
        F.least(F.coalesce(finish / F.lit(end or 1.0), F.lit(1.0)), F.lit(1.0)).alias(
            "virtual_finish"
        ),
        given.alias("words"),
        F.lit(0).alias("__all"),
    ).where("words > 0 OR copy = 0")
    order = ["virtual_finish", "key", "key2", "row", "copy"]
    # Those that finish at the very end are as many as there are sources, or are not in at all.
    place = F.when(F.col("words") > 0, F.col("virtual_finish")).otherwise(
        F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    )
    placed = total_before(
        offered, "__all", F.lit(offered.count()), place, order, "words", "position"
    )
    return placed.drop("__all")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_share: float = 1.5,
    rounds: int = ROUNDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    ordered: bool = True,
) -> DataFrame:
    """The mixed corpus: a row of the input's columns for every copy, with ``copy``,
    ``mix_words`` and ``mix_position``, range-sorted by position if ``ordered``.

    A copy that the mix does not take whole has its first words, joined by one space.
    """
    plan = schedule(docs, weights, budget_share, rounds, id_column, text_column, source_column)
    plan = plan.where("words > 0").select(
        F.col("key").alias("__key"),
        F.col("key2").alias("__key2"),
        F.col("copy").alias("__copy"),
        F.col("size").alias("__size"),
        F.col("words").alias("__words"),
        F.col("position").alias("__position"),
    )
    own = {"copy", "mix_words", "mix_position"} - {id_column, text_column, source_column}
    columns = [c for c in docs.columns if c not in own]
    every = [named(c) for c in docs.columns]
    # Rows alike in every column are one text here; the plan holds as many copies as it should.
    once = docs.withColumns(
        {"__key": F.xxhash64(F.lit(11), *every), "__key2": F.xxhash64(F.lit(12), *every)}
    ).dropDuplicates(["__key", "__key2"])
    text = named(text_column)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("__words").cast("int")), " ")
    mixed = once.join(plan, ["__key", "__key2"]).withColumn(
        text_column, F.when(F.col("__words") < F.col("__size"), cut).otherwise(text)
    )
    if ordered:
        mixed = mixed.orderBy("__position", "__key", "__key2", "__copy")
    return mixed.select(
        *map(named, columns),
        F.col("__copy").alias("copy"),
        F.col("__words").alias("mix_words"),
        F.col("__position").alias("mix_position"),
    )
