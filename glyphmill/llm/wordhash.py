"""Hashes of all words of a block of texts, by whole arrays: no Python object per word.

A word's hash is a polynomial of its bytes modulo 2^64 (from running sums, so one pass serves
all words), finished by a mixing step. Blocks are cut at separators, so memory does not grow
with a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
BLANKS = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of a public 64-bit generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class WordHasher:
    """separators: the bytes between words; table: what each byte counts as (for folding)."""

    def __init__(self, separators: bytes = BLANKS, fold: bytes | None = None):
        self._sep = np.zeros(256, bool)
        self._sep[list(separators)] = True
        codes = np.frombuffer(fold, np.uint8) if fold else np.arange(256)
        self._table = _TABLE[codes]
        self._pow = self._inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self._pow = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self._inv = np.multiply.accumulate(steps)

    def _block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        n = len(raw)
        self._powers(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self._sep[raw]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._table[raw] * self._pow[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._inv[starts]), starts

    def _cuts(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(raw):
            end = at + BLOCK_BYTES
            while end < len(raw):
                found = np.flatnonzero(self._sep[raw[end : end + BLOCK_BYTES]])
                if len(found):
                    end += int(found[0])
                    break
                end += BLOCK_BYTES
            yield at, min(end, len(raw))
            at = end

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of the bytes."""
        parts = [(h, s + a) for a, b in self._cuts(raw) for h, s in [self._block(raw[a:b])]]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, ends of rows) of a string column; nulls are empty.

    Rows are separated by one blank, and a block has at least one row.
    """
    texts = column.cast(pa.large_binary()) if len(column) else []
    sizes = [len(x) if (x := t.as_buffer()) is not None else 0 for t in texts]
    first = 0
    while first < len(sizes):
        last, total = first, 0
        while last < len(sizes) and (last == first or total + sizes[last] <= block_bytes):
            total += sizes[last]
            last += 1
        joined = b" ".join((texts[i].as_py() or b"") for i in range(first, last))
        ends = np.cumsum(np.array(sizes[first:last], np.int64) + 1) - 1
        yield first, last, np.frombuffer(joined, np.uint8), ends
        first = last


def combine(hashes: Iterable[np.ndarray], salt: int) -> np.ndarray:
    """One hash of several in order."""
    out = None
    for h in hashes:
        out = h if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + h)
    return mix(out ^ np.uint64(salt & _MASK))
