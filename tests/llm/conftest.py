"""Rows that every corpus operator must bear, and helpers for brute force."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture
def word_list():
    return words


@pytest.fixture
def hard_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "n1"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "n3"),
        (4, " \t\n ", "en", None, 4, "n4"),
        (5, long, "en", "b", len(long), "n5"),
        (6, long, "en", "b", len(long), "n5"),
        (None, "a text without an id ünd mit Umlauten", "de", "b", 1, "n7"),
        (8, "one two three four five six seven", None, "a", 33, "n8"),
        (8, "one two three four five six seven", None, "a", 33, "n8"),
        (9, "12 34 -- 56", "en", "c", 11, "n9"),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    )
    return spark.createDataFrame(rows, schema).repartition(3)
