"""Hashed subwords: runs of two to four characters of lower-cased text, in whole texts.

Every run of characters that are no letters becomes one boundary mark, so subwords know where a
word begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from custvalue.llm.wordhash import mixed

SIZES = (2, 3, 4)
_PIECE = 1 << 18  # characters looked at together; longer texts take several pieces
_BOUNDARY = np.uint32(32)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts, a bounded number at a time, and the text that owns each."""
    codes, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, len(text or ""), _PIECE):
            part = np.frombuffer(text[low : low + _PIECE].lower().encode("utf-32-le", "replace"), "<u4")
            codes.append(part)
            owners.append(np.full(len(part), i, np.int32))
            held += len(part)
            if held >= _PIECE:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, held = [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(owners)


def subwords(
    texts: Sequence[str | None], bits: int, sizes: Sequence[int] = SIZES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, edges, texts): the buckets between two edges belong to the text named there.

    Subwords of each size come in turn; a text without a letter has none.
    """
    known = letters()
    for codes, owners in _pieces(texts):
        letter = known[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of other characters stays as a boundary
        new = np.ones(len(codes), bool)
        new[1:] = owners[1:] != owners[:-1]
        keep |= new
        code = np.where(letter, codes, _BOUNDARY)[keep].astype(np.uint64)
        owner = owners[keep]
        has_letter = np.zeros(int(owner[-1]) + 1, bool)
        has_letter[np.unique(owner[letter[keep]])] = True
        value = code
        for size in range(2, max(sizes) + 1):
            if len(code) < size:
                break
            value = value[:-1] * np.uint64(0x100000001B3) + code[size - 1 :]
            if size not in sizes:
                continue
            same = (owner[size - 1 :] == owner[: len(owner) - size + 1])
            same &= has_letter[owner[: len(same)]]
            mine = owner[: len(same)][same]
            if not len(mine):
                continue
            bucket = (mixed(value[same] + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
            first = np.ones(len(mine), bool)
            first[1:] = mine[1:] != mine[:-1]
            edges = np.flatnonzero(first)
            yield bucket, edges, mine[edges]


def bucket_counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and their shares of its subwords."""
    total = np.zeros(1 << bits, np.int64)
    for bucket, _, _ in subwords([text], bits):
        total += np.bincount(bucket, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found] / max(total.sum(), 1)


def means(texts: Sequence[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of the table's rows at its subwords, and how many it has."""
    bits = int(table.shape[0]).bit_length() - 1
    sums = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts), np.int64)
    for bucket, edges, text in subwords(texts, bits):
        sums[text] += np.add.reduceat(table[bucket], edges, axis=0)
        count[text] += np.diff(np.append(edges, len(bucket)))
    return sums / np.maximum(count, 1)[:, None], count


def shares(texts: Sequence[str | None], bits: int) -> np.ndarray:
    """Per text the share of its subwords in each bucket."""
    size = 1 << bits
    total = np.zeros(len(texts) * size, np.int64)
    for bucket, edges, text in subwords(texts, bits):
        owner = np.repeat(text.astype(np.int64), np.diff(np.append(edges, len(bucket))))
        total += np.bincount(owner * size + bucket, minlength=len(total))
    total = total.reshape(len(texts), size)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)
