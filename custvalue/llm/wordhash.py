"""Words of many texts at once as 64-bit hashes, and hashes of runs of words.

A word is a run of bytes other than space and the control characters 9 to 13, so no UTF-8
character is cut. Words of up to 16 bytes are read as one or two whole numbers and mixed, on NumPy
arrays: words of equal length up to 8 bytes never share a hash. Longer words, few in most texts,
get a cryptographic digest. Sums of bytes times powers would not do: modulo 2**64 they are equal
for words that anyone can write down.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_RUN_BASE = 0xD1342543DE82EF95 | 1

# The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

# A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PART = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a value spread over all bits of the result (one to one)."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts in order. ``first[d]`` is the index of the first word of text d."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, the words of its text from there on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _numbers(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word ``part[begin:end]``."""
    padded = np.concatenate([part, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(part) + 9, "<u8", padded, strides=(1,))  # from every byte on
    size = end - begin
    value = eight[begin]
    value &= _FIRST[np.minimum(size, 8)]
    value += size.astype(np.uint64) * _LENGTH
    value = mixed(value)
    more = np.flatnonzero((size > 8) & (size <= 16))
    rest = eight[begin[more] + 8] & _FIRST[size[more] - 8]
    value[more] = mixed(value[more] * _SECOND + mixed(rest))
    long = np.flatnonzero(size > 16)
    if len(long):
        view = memoryview(np.ascontiguousarray(part))
        spans = zip(begin[long].tolist(), end[long].tolist())
        digests = b"".join(blake2b(view[a:b], digest_size=8).digest() for a, b in spans)
        value[long] = np.frombuffer(digests, "<u8")
    return value


def _cut(data: np.ndarray, low: int, breaks: np.ndarray, separators: np.ndarray) -> int:
    """Where a part that starts at ``low`` may end: at a separator or the start of a text."""
    high = low + _PART
    if high >= len(data):
        return len(data)
    border = breaks[np.searchsorted(breaks, high)]
    while high < border:
        step = separators[data[high : min(high + 4096, border)]]
        if step.any():
            return high + int(step.argmax())
        high = min(high + 4096, border)
    return int(border)


def words(
    data: np.ndarray,
    offsets: np.ndarray,
    separators: np.ndarray = SPACE,
    classes: np.ndarray | None = None,
) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``.

    ``separators`` may name other separating bytes. ``classes`` gives bytes a class 1 or 2: a
    word also ends between neighbours of class 1 and class 2.
    """
    starts, ends, hashes, low = [], [], [], 0
    breaks = offsets[:-1]
    borders = np.append(breaks, len(data))
    while low < len(data):
        high = _cut(data, low, borders, separators)
        part = data[low:high]
        inside = ~separators[part]
        joined = inside[1:] & inside[:-1]
        if classes is not None:
            kind = classes[part]
            joined &= kind[1:] * kind[:-1] != 2
        here = breaks[np.searchsorted(breaks, low + 1) : np.searchsorted(breaks, high)] - low
        joined[here - 1] = False
        opening = inside.copy()
        opening[1:] &= ~joined
        closing = inside
        closing[:-1] &= ~joined
        begin = np.flatnonzero(opening)
        end = np.flatnonzero(closing) + 1
        starts.append(begin + low)
        ends.append(end + low)
        hashes.append(_numbers(part, begin, end))
        low = high
    if not starts:
        nothing = np.empty(0, np.int64)
        return Words(nothing, nothing, nothing.astype(np.uint64), np.zeros_like(offsets))
    begin = np.concatenate(starts)
    first = np.searchsorted(begin, offsets)
    return Words(begin, np.concatenate(ends), np.concatenate(hashes), first)


def runs(hashes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of the runs of ``size`` values from every place on, for each wanted size.

    By doubling: a run of 2k is two runs of k. Borders between texts are the caller's matter.
    """
    out, ladder, size = {}, {1: hashes}, 1
    most = max(sizes)
    while size * 2 <= min(most, max(len(hashes), 1)):
        half = ladder[size]
        shift = np.uint64(pow(_RUN_BASE, size, 2**64))
        ladder[size * 2] = half[:-size] * shift + half[size:]
        size *= 2
    for wanted in sizes:
        if wanted > len(hashes):
            out[wanted] = np.empty(0, np.uint64)
            continue
        value, length = None, 0
        for bit in reversed(range(wanted.bit_length())):
            step = 1 << bit
            if not wanted & step:
                continue
            if value is None:
                value = ladder[step]
            else:
                more = ladder[step][length:]
                value = value[: len(more)] * np.uint64(pow(_RUN_BASE, step, 2**64)) + more
            length += step
        out[wanted] = mixed(value[: len(hashes) - wanted + 1] + np.uint64(wanted))
    return out


def tagged(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values made different for different owners, to look at many texts in one sort."""
    return mixed(values + mixed(owner.astype(np.uint64) + np.uint64(1)))


def repeated(values: np.ndarray) -> np.ndarray:
    """Mask of the values that occur twice or more."""
    ordered = np.sort(values)
    several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(several):
        return np.zeros(len(values), bool)
    place = np.searchsorted(several, values)
    place[place == len(several)] = 0
    return several[place] == values


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Mask of the places 0 to ``length - 1`` that lie in a run of ``size`` from some start."""
    change = np.zeros(length + size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:length]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each stretch between offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
