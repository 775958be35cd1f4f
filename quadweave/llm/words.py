"""Word tables of Arrow text columns: one vectorised pass finds the words of many texts and hashes them.

A word is a maximal run of word bytes.  UTF-8 makes byte classes exact here: every word class in use is defined by
ASCII characters, and bytes from 0x80 on belong to words.  Words never cross from one text to the next.
Hashes are 64 bits wide: a word's bytes, each replaced by a random 64-bit value, are summed with powers of an odd base,
then mixed.  Equal words have equal hashes; unequal ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; keeps the arrays near the CPU's cache whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 18
#: The same column in SQL: words of the contracts that split on ASCII white space only.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits (works in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mixed(value: int) -> int:
    return int(mix(np.array([value & _MASK], np.uint64))[0])


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the random value that stands for each."""

    word: np.ndarray
    value: np.ndarray


def alphabet(separators: set[int], lower: bool) -> Alphabet:
    word = np.array([b not in separators for b in range(256)])
    seen = [b + 32 if lower and 0x41 <= b <= 0x5A else b for b in range(256)]
    value = np.array([mixed(0xA5A5 + 7919 * b) for b in seen], np.uint64)
    return Alphabet(word, value)


_SPACES = {0x20, *range(0x09, 0x0E)}
#: Words between ASCII white space, as they are, or with A-Z lower-cased.
SPACED = alphabet(_SPACES, lower=False)
SPACED_LOWER = alphabet(_SPACES, lower=True)
#: Runs of ASCII letters, ASCII digits and all characters beyond ASCII, with A-Z lower-cased.
ALNUM_LOWER = alphabet({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  a cache
    if base not in known or len(known[base]) < n:
        p = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        p[0] = 1
        known[base] = np.cumprod(p, dtype=np.uint64)
    return known[base][:n]


@dataclass
class Words:
    """hashes[i], first[i], last[i]: hash and byte range of word i; at[d]:at[d + 1] are the words of text d."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, letters: Alphabet) -> Words:
    """All words of the texts data[offsets[d]:offsets[d + 1]]."""
    n = len(data)
    inside = letters.word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(first), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    i = 0
    while i < len(first):  # blocks of whole words
        j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK_BYTES)))
        lo, hi = first[i], last[j - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(letters.value[data[lo:hi]] * _powers(_BASE, hi - lo), out=sums[1:])
        a, b = first[i:j] - lo, last[i:j] - lo
        hashes[i:j] = mix((sums[b] - sums[a]) * _powers(inverse, hi - lo)[a] + (b - a).astype(np.uint64))
        i = j
    return Words(hashes, first, last, np.searchsorted(first, offsets), data)


def chunks(column: pa.Array, letters: Alphabet, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, Words]]:
    """The words of a text column in runs of about `size` bytes, texts kept whole, with the rows of each run."""
    data, offsets = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield slice(i, j), words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters)
        i = j


_ODD = [mixed(0x1234567 + 31 * i) | 1 for i in range(256)]


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and at: the runs of text d are at[d]:at[d + 1]."""
    h, n = found.hashes, len(found.hashes)
    counts = np.maximum(found.counts - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, np.uint64), at
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * np.uint64(_ODD[i])
    ends = np.repeat(found.at[1:], found.counts)[: n - k + 1]
    return mix(total[np.arange(n - k + 1) + k <= ends] + np.uint64(k)), at


def whole(h: np.ndarray) -> np.uint64:
    """The hash of one run of words of any length, equal to that of grams() for the same length."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for i, x in enumerate(h):
            total += x * np.uint64(_ODD[i])
    return mix(np.array([total], np.uint64) + np.uint64(len(h)))[0]
