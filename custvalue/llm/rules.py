"""Quality rules as a bitmask ledger.

``ledger`` reads every text once: it measures each document and sets one bit for each rule that
the document fails. Policies and their ablations then work on the ledger's integers alone, so a
new policy version costs no second look at any text.

Defined results: a null or empty text has no words and every measure 0. Documents are judged one
by one, so ties and repeated rows give equal rows. An empty table gives an empty ledger, an empty
ablation report and zero totals. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.llm import wordhash as W
from custvalue.llm.shared import named, small_batches, text_parts

_RUN = 5
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = np.arange(256) == 10

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
)

# Rule name to the condition under which a document fails, in terms of the measures. Bits follow
# this order; new rules go to the end, so that older ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_runs": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_or_long_words": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "few_letters": "100 * n_letters < 50 * word_chars",
}


@dataclass(frozen=True)
class Policy:
    """A named version: a document is dropped when it fails any of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_runs"))
CURRENT = Policy("2", tuple(RULES))


def _dup_lines(data: np.ndarray, offsets: np.ndarray, w: W.Words) -> tuple[np.ndarray, ...]:
    lines = W.words(data, offsets, separators=_NEWLINE)
    full = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    owner, value = lines.text_of()[full], lines.hashes[full]
    n = len(offsets) - 1
    count = np.bincount(owner, minlength=n)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return count, count - np.bincount(owner[new], minlength=n)


def _repeat_words(w: W.Words) -> np.ndarray:
    run = W.runs(w.hashes, [_RUN])[_RUN]
    whole = np.flatnonzero(w.room()[: len(run)] >= _RUN)
    again = whole[W.repeated(W.tagged(run[whole], w.text_of()[whole]))]
    return W.per_text(W.covered(again, _RUN, len(w.hashes)), w.first)


_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[192:] = True  # the first byte of any character beyond ASCII counts as a letter


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text."""
    w = W.words(data, offsets)
    lines, dup_lines = _dup_lines(data, offsets, w)
    return {
        "n_words": w.counts,
        "word_chars": W.per_text(~W.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": W.per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeat_words(w),
        "n_lines": lines,
        "n_letters": W.per_text(_LETTERS[data], offsets),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_parts(batch.column(1)):
            columns = {"doc_id": batch.column(0).slice(low, high - low)}
            columns |= {k: pa.array(v.astype(np.int64)) for k, v in measure(data, offsets).items()}
            yield pa.RecordBatch.from_pydict(columns)


def ledger(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: Mapping[str, str] = RULES,
) -> DataFrame:
    """Per document its id, the measures, and ``failed``: bit i is set where rule i fails."""
    kind = docs.select(named(id_column)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(named(id_column).alias("doc_id"), named(text_column).alias("text"))
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())]
    failed = bits[0].cast("long")
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit.cast("long"))
    return small_batches(rows).mapInArrow(_measured, schema).withColumn("failed", failed)


def kept(policy: Policy) -> Column:
    """Whether a policy keeps a document of the ledger."""
    return F.col("failed").bitwiseAND(policy.mask) == 0


def ablations(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those it alone drops.

    The ledger shrinks to one row per bitmask first (at most 2 to the number of rules).
    """
    names = list(RULES)
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p.version).alias("policy"),
                    F.lit(rule).alias("rule"),
                    F.lit(p.mask).cast("long").alias("mask"),
                    F.lit(1 << names.index(rule)).cast("long").alias("bit"),
                )
                for p in policies
                for rule in p.rules
            ]
        )
    )
    hits = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return (
        patterns.select("failed", "n", rows.alias("r"))
        .select("failed", "n", "r.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.when(hits, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("dropped_by_it_alone"),
        )
    )
