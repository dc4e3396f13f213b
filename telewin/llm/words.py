"""Words of many texts at once, as 64-bit hashes, from the bytes of an Arrow column.

Texts are looked at in blocks of half a MB and always whole: a text longer than a
block is a block of its own. Only A-Z are folded to lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def word_bytes(separators: bytes) -> np.ndarray:
    """A table of the bytes that belong to words, given those that do not."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = word_bytes(b"\x20\x09\x0a\x0b\x0c\x0d")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
LETTERS_DIGITS = word_bytes(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block(NamedTuple):
    """Words of the texts ``first`` to ``first + texts - 1`` of a column."""

    first: int
    texts: int
    bytes: np.ndarray
    doc: np.ndarray  # of each word: its text, from 0 in this block
    start: np.ndarray  # of each word: its bytes
    end: np.ndarray
    prefix: np.ndarray  # running hash of the bytes
    inverse: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Of each word, or of its first ``most`` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        size = (end - self.start).astype(np.uint64)
        return mix((self.prefix[end] - self.prefix[self.start]) * self.inverse[self.start] + size * _BYTE[0])

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8), offsets


def blocks(column: pa.Array, table: np.ndarray) -> Iterator[Block]:
    data, offsets = utf8(column)
    n, at = len(column), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield _block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, table)
        at = to
    pa.default_memory_pool().release_unused()  # else idle Python workers keep it


def _block(raw: np.ndarray, offsets: np.ndarray, first: int, table: np.ndarray) -> Block:
    low = _LOWER[raw]
    word = np.zeros(len(low) + 1, dtype=bool)
    word[:-1] = table[low]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = word[:-1]
    edge = np.zeros(len(low) + 1, dtype=bool)  # a text begins here: it neither continues nor is continued
    edge[offsets] = True
    start = np.flatnonzero(word & (~before | edge))
    end = np.flatnonzero(before & (~word | edge))
    running = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * powers(_BASE, len(low)), out=running[1:])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Block(first, len(offsets) - 1, low, doc, start, end, running, powers(_BASE_INVERSE, len(low) + 1))


def grams(hashes: np.ndarray, doc: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words and their texts; of a shorter text, its whole sequence."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = powers(_U(0xD6E8FEB86659FD93), k + 1)
    head = np.maximum(n - k + 1, 0)
    run = np.zeros(head, dtype=np.uint64)
    for j in range(k):
        run += hashes[j : j + head] * factor[j]
    whole = doc[:head] == doc[k - 1 :] if head else np.zeros(0, bool)
    found, owner = mix(run[whole] + _U(k)), doc[:head][whole]
    count = np.bincount(doc, minlength=texts)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(count)])
        value = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            value[has] += hashes[at[short[has]] + j] * factor[j]
        found = np.concatenate([found, mix(value + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner
