"""Licence scan by ordered signature rules.

A text becomes its words, in lower case, one space between. Each rule is a pattern over words with
a priority; it is tried only on texts that hold its keyword. Detections that overlap are resolved:
of two of which one lies within the other the one of higher priority stays, of equal priority the
longer one, of equal length that of the earlier rule. Base rules are counted and reported whatever
becomes of their detections.

Defined results: a null text, an empty one and one of marks alone have no words, no labels (an
empty string) and score 0. Texts are judged one by one, so repeated rows give equal rows, and rows
without an id come back without one. An empty table gives an empty table. Other columns are not
read, whatever their names. Texts may be of any length: every pattern spans a bounded number of
words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from custvalue.llm.license_rules import CONFIDENCE, SIGNATURES, Rule
from custvalue.llm.shared import named, small_batches, text_parts
from custvalue.llm.wordhash import LOWER, per_text

# Bytes of words: letters, digits, and whatever is not ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def in_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as words with one space between: bytes, where each text begins, and its number
    of words."""
    inside = _WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    counts = per_text(inside & ~before, offsets)
    kept = inside | before
    at = np.concatenate([[0], np.cumsum(kept)])[offsets]
    return np.where(inside, LOWER[data], 32).astype(np.uint8)[kept], at, counts


def resolved(start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Mask of the detections that stay, given in the order of their rules."""
    stay = np.zeros(len(start), bool)
    for level in np.unique(priority):
        here = np.flatnonzero(priority == level)
        strong = np.flatnonzero(stay)
        if len(strong):
            strong = strong[np.argsort(start[strong], kind="stable")]
            begins, ends = start[strong], end[strong]
            reach = np.concatenate([[-1], np.maximum.accumulate(ends)])
            first_end = np.append(np.minimum.accumulate(ends[::-1])[::-1], np.iinfo(np.int64).max)
            within = reach[np.searchsorted(begins, start[here], "right")] >= end[here]
            holds = first_end[np.searchsorted(begins, start[here], "left")] <= end[here]
            here = here[~within & ~holds]
        # Of one priority: by start, the longest first; what ends no later lies within.
        here = here[np.lexsort((here, -end[here], start[here]))]
        furthest = np.concatenate([[-1], np.maximum.accumulate(end[here])])[: len(here)]
        stay[here[end[here] > furthest]] = True
    return stay


class Scanner:
    """Compiled rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [
            (rule, re.compile(rb"(?<![^ ])(?:%b)(?![^ ])" % rule.pattern.encode()))
            for rule in rules
        ]
        self.by_keyword: dict[bytes, list[int]] = {}
        for number, rule in enumerate(rules):
            self.by_keyword.setdefault(rule.keyword.encode(), []).append(number)

    def tried(self, text: bytes, at: np.ndarray) -> dict[int, list[int]]:
        """Which rules to try on which texts. From a hit on, the search goes on in the next text,
        so a frequent keyword costs no more than the texts that hold it."""
        begins, out = at[:-1], {}
        for keyword, numbers in self.by_keyword.items():
            place = text.find(keyword)
            while place >= 0:
                one = int(np.searchsorted(begins, place, "right")) - 1
                stop = int(at[one + 1])
                if place + len(keyword) <= stop:  # else it runs over into the next text
                    out.setdefault(one, []).extend(numbers)
                place = text.find(keyword, stop if place + len(keyword) <= stop else place + 1)
        return out

    def judge(self, text: bytes, numbers: list[int]) -> dict:
        found = []
        base_labels, base_starts = set(), []
        for number in sorted(numbers):
            rule, pattern = self.rules[number]
            spans = [match.span() for match in pattern.finditer(text)]
            found += [(a, b, rule.priority, number) for a, b in spans]
            if rule.base and spans:
                base_labels.add(rule.label)
                base_starts += [a for a, _ in spans]
        if not found:
            return {}
        start, end, priority, number = np.array(found, np.int64).T
        stay = resolved(start, end, priority)
        labels = {self.rules[i][0].label for i in np.unique(number[stay]).tolist()}
        out = {
            "labels": ",".join(sorted(labels | base_labels)),
            "score": max(CONFIDENCE[p] for p in priority[stay].tolist()),
        }
        if base_starts:
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            words = np.searchsorted(spaces, np.array(base_starts))
            out |= {
                "base_labels": ",".join(sorted(base_labels)),
                "n_base": len(base_starts),
                "first_word": int(words.min()),
                "last_word": int(words.max()),
            }
        return out


_FIELDS = {
    "n_base": (0, pa.int64(), LongType()),
    "first_word": (None, pa.int64(), LongType()),
    "last_word": (None, pa.int64(), LongType()),
    "base_labels": ("", pa.string(), StringType()),
    "labels": ("", pa.string(), StringType()),
    "score": (0.0, pa.float64(), DoubleType()),
}


def scanned(
    docs: DataFrame,
    rules: Sequence[Rule] = SIGNATURES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per text: doc_id, n_words, n_base (places of base phrases), first_word and last_word (the
    words these places start at, smallest and largest), base_labels, labels, score (how sure the
    surest detection that stays is, 0 without any)."""
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column(1)):
                words, at, counts = in_words(data, offsets)
                text = words.tobytes()
                judged: list[dict] = [{}] * (high - low)
                for one, numbers in scanner.tried(text, at).items():
                    judged[one] = scanner.judge(text[at[one] : at[one + 1]], numbers)
                columns = [batch.column(0).slice(low, high - low), pa.array(counts, pa.int64())]
                for name, (empty, kind, _) in _FIELDS.items():
                    columns.append(pa.array([j.get(name, empty) for j in judged], kind))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", *_FIELDS])

    rows = docs.select(named(id_column).alias("doc_id"), named(text_column))
    fields = [rows.schema[0], StructField("n_words", LongType())]
    fields += [StructField(name, kind) for name, (_, _, kind) in _FIELDS.items()]
    return small_batches(rows).mapInArrow(scan, StructType(fields))
