"""Suffixes of a text in order, with common-prefix lengths, by external induced sorting.

Suffixes that begin a rise (LMS) are sorted first; from them the falling (L) suffixes are
induced in ascending and the rising (S) ones in descending order. Both inductions pop suffix
tuples (position, common prefix with the one before) from a priority queue. A tuple's priority
is its first symbol and then its turn, so the queue is a lane per symbol, first in, first out.
Common prefixes are carried through: of two suffixes induced one after the other into a lane,
it is one more than the smallest met since. Whole runs of a lane are handled as arrays.

LMS suffixes are sorted by recursion: an induction from unsorted LMS places brings the pieces
between them into order, equal pieces get equal names, and the suffixes of the string of names
(written in symbols of 16 bits) are sorted the same way. The recursion ends where the LMS
places of a level fit in memory; those are sorted there by doubling.

A text of more than `limit` symbols is held on disk with all that grows with it: its symbols,
their kinds, the LMS places, their order and names, and what queue lanes and falling tuples
hold beyond the limit. Files are unlinked temporary ones, so they vanish with the process. The
memory used depends on the limit and on the number of different symbols, not on the text.

Order and prefixes are exact up to DEPTH symbols, which is all that callers ask for.
"""

from __future__ import annotations

import bisect
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

DEPTH, MEMORY_TUPLES, CHUNK_TUPLES = 208, 8_000_000, 500_000
_FAR = np.int16(DEPTH)
Chunks = Iterator[tuple[np.ndarray, np.ndarray]]


def disk_array(n: int, dtype: type | str, limit: int) -> np.ndarray:
    """Zeros: in memory up to the limit, else in an unlinked file."""
    if n <= limit:
        return np.zeros(n, dtype)
    f = tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the array's map of it
    f.truncate(n * np.dtype(dtype).itemsize)
    return np.memmap(f, dtype, "r+", shape=(n,))


def _pieces(n: int, size: int = CHUNK_TUPLES) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


class Lanes:
    """The priority queue: per first symbol, tuples in the order of arrival; beyond a limit all go to disk."""

    def __init__(self, limit: int = MEMORY_TUPLES):
        self._held: dict[int, list] = defaultdict(list)
        self._disk: dict[int, deque] = defaultdict(deque)
        self._limit, self._in_memory, self._file, self._end = max(1, limit), 0, None, 0
        self.most = 0  # tuples in memory at most

    def push(self, lane: int, positions: np.ndarray, common: np.ndarray) -> None:
        for a, b in _pieces(len(positions), self._limit):
            self._held[lane].append((positions[a:b], common[a:b]))
            self._in_memory += b - a
            self.most = max(self.most, self._in_memory)
            if self._in_memory >= self._limit:
                self._flush()

    def _flush(self) -> None:
        self._file = self._file or tempfile.TemporaryFile()  # noqa: SIM115
        self._file.seek(self._end)
        for lane, parts in self._held.items():
            positions, common = (np.concatenate(x) for x in zip(*parts, strict=True))
            self._file.write(positions.astype(np.int64).tobytes())
            self._file.write(common.astype(np.int16).tobytes())
            self._disk[lane].append((self._end, len(positions)))
            self._end += 10 * len(positions)
        self._held.clear()
        self._in_memory = 0

    def _load(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self._file.seek(at)
        return np.frombuffer(self._file.read(8 * n), np.int64), np.frombuffer(self._file.read(2 * n), np.int16)

    def _take(self, lane: int) -> list:
        parts = self._held.pop(lane, [])
        self._in_memory -= sum(len(p) for p, _ in parts)
        return parts

    def pop(self, lane: int) -> Chunks:
        """Chunks until the lane stays empty; what is pushed meanwhile comes last."""
        while True:
            some, size = [], 0
            while self._disk[lane] and size < CHUNK_TUPLES:
                some.append(self._load(*self._disk[lane].popleft()))
                size += len(some[-1][0])
            some = some or self._take(lane)
            if not some:
                return
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))

    def back(self, lane: int) -> Chunks:
        """Chunks from the last to the first, each in its own order."""
        yield from self._take(lane)[::-1]
        while self._disk[lane]:
            yield self._load(*self._disk[lane].pop())


def rising(t: np.ndarray, limit: int = MEMORY_TUPLES) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last place counts as rising."""
    n = len(t)
    up = disk_array(n, bool, limit)
    up[n - 1], carried, after = True, True, t[n - 1]
    for a, b in reversed(list(_pieces(n - 1))):
        own = np.append(t[a:b], after)
        here, there = own[:-1], own[1:]
        nearest = np.minimum.accumulate(np.where(here != there, np.arange(b - a), b - a)[::-1])[::-1]  # first place from here on where symbols differ
        up[a:b] = np.append(here < there, carried)[nearest]
        carried, after = up[a], here[0]
    return up


def _run(t: np.ndarray, at: int) -> int:
    """How often the symbol at the place repeats from there on, at most DEPTH."""
    own = np.asarray(t[at : at + DEPTH])
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def _lms(up: np.ndarray, limit: int) -> np.ndarray:
    starts = lambda a, b: np.flatnonzero(up[a:b] & ~up[a - 1 : b - 1]) + a
    spans = [(max(a, 1), b) for a, b in _pieces(len(up))]
    out, at = disk_array(sum(len(starts(a, b)) for a, b in spans), np.int64, limit), 0
    for a, b in spans:
        own = starts(a, b)
        out[at : at + len(own)] = own
        at += len(own)
    return out


def _refine(rank: np.ndarray, word: np.ndarray, some: np.ndarray) -> None:
    """Splits groups of equal rank by word, for the rows of whole groups. Ranks are where a group begins in the order."""
    r = rank[some]
    if len(r) and (r[0] != r[-1] or (r != r[0]).any()):  # one number of both: it sorts several times as fast as two keys
        most = int(word.max()) + 1
        if most * (int(r.max()) + 1) >= 1 << 63:
            order = np.argsort(word)
            number = np.empty(len(word), np.int64)
            number[order] = np.cumsum(np.append(False, word[order][1:] != word[order][:-1]))
            word, most = number, int(number.max()) + 1
        word = r * most + word
    pick = np.argsort(word)
    r, w = r[pick], word[pick]
    i = np.arange(len(r))
    new_group = np.append(True, r[1:] != r[:-1])
    new_part = np.append(True, w[1:] != w[:-1])  # where a group begins as well
    begin = np.maximum.accumulate(np.where(new_group, i, 0))
    part = np.maximum.accumulate(np.where(new_part, i, 0))
    rank[some[pick]] = r + part - begin


def _tied(rank: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Those of some whose rank another of them has."""
    own = rank[some]
    return some[np.bincount(own)[own] > 1] if len(some) else some


def _order_in_memory(t: np.ndarray, up: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The end of the recursion: names of pieces by several symbols at a time, then the string of names by doubling."""
    bits = 8 * t.dtype.itemsize + 1
    per = 63 // bits
    length = np.append(np.diff(lms) + 1, 1)  # a piece reaches to the next one's first symbol
    most = min(int(length.max()), DEPTH)

    def part(rows: np.ndarray, j: int) -> np.ndarray:
        word, first, own = np.zeros(len(rows), np.int64), lms[rows], length[rows]
        for k in range(per * j, per * (j + 1)):
            at = np.minimum(first + k, len(t) - 1)
            word <<= bits
            word |= ((t[at].astype(np.int64) << 1) | up[at]) * (k < own)
        return word

    rank, left = np.zeros(len(lms), np.int64), np.arange(len(lms))
    _refine(rank, part(left, 0), left)
    for j in range(1, -(-most // per)):
        tied = left = _tied(rank, left)
        longer = np.zeros(len(lms), bool)
        longer[rank[tied[length[tied] > per * j]]] = True
        tied = tied[longer[rank[tied]]]
        if not len(tied):
            break
        _refine(rank, part(tied, j), tied)
    step = 1
    while step < DEPTH // 2 and len(left := _tied(rank, left)):
        ahead = left + step
        _refine(rank, np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)] + 1, 0), left)
        step *= 2
    return lms[np.argsort(rank, kind="stable")]


def _same_pieces(t: np.ndarray, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether the pieces at a and b are equal, over DEPTH symbols at most."""
    same = length_a == length_b
    rows = np.flatnonzero(same)
    for k in range(DEPTH):
        rows = rows[length_a[rows] > k]
        if not len(rows):
            break
        equal = t[a[rows] + k] == t[b[rows] + k]
        same[rows[~equal]] = False
        rows = rows[equal]
    return same


def _order_by_recursion(t: np.ndarray, up: np.ndarray, lms: np.ndarray, symbols: np.ndarray, limit: int) -> np.ndarray:
    """LMS suffixes in order, all that grows with them on disk."""
    m, n = len(lms), len(t)
    places = Lanes(limit // 2)
    for a, b in _pieces(m):
        own = lms[a:b]
        first = t[own]
        by = np.argsort(first, kind="stable")
        found, begin = np.unique(first[by], return_index=True)
        for c, i, j in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), b - a], strict=True):
            places.push(c, own[by[i:j]], np.zeros(j - i, np.int16))
    names, order, told, before, name = disk_array(m, np.int64, limit), disk_array(m, np.int64, limit), m, None, 0
    for positions, _ in _induce(t, up, symbols, places.pop, limit, prefixes=False):
        own = positions[up[positions] & ~up[np.maximum(positions - 1, 0)] & (positions > 0)]
        if not len(own):
            continue
        row = np.searchsorted(lms, own)
        length = np.where(row + 1 < m, lms[np.minimum(row + 1, m - 1)] - own + 1, 1)
        left, left_length = (own[:1], length[:1]) if before is None else before
        same = _same_pieces(t, own, np.append(left, own[:-1]), length, np.append(left_length, length[:-1]))
        same[0] &= before is not None
        number = name + np.cumsum(~same)
        names[row] = number
        order[told - len(own) : told] = own[::-1]
        told, name, before = told - len(own), int(number[-1]), (own[-1:], length[-1:])
    if name == m:
        return order  # all pieces differ
    # Names run down from the largest piece's 1 to name; a symbol 0 ends the string.
    wide = 2 if name > 65_535 and 2 * m < 0.75 * n else 1
    kind = np.uint16 if name <= 65_535 or wide == 2 else np.uint32
    string = disk_array(wide * m + 1, kind, limit)
    for a, b in _pieces(m):
        own = name + 1 - names[a:b]
        if wide == 2:
            string[2 * a : 2 * b : 2], string[2 * a + 1 : 2 * b : 2] = own // 65_535 + 1, own % 65_535 + 1
        else:
            string[a:b] = own
    del names
    told = m
    for positions, _ in sorted_suffixes(string, limit, prefixes=False):
        own = positions[(positions % wide == 0) & (positions < wide * m)] // wide
        order[told - len(own) : told] = lms[own][::-1]
        told -= len(own)
    return order


def common_prefixes(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, at most DEPTH; padded: the text and DEPTH + 16 bytes more."""
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out, rows = np.zeros(len(a), np.int16), np.arange(len(a))
    for at in range(0, DEPTH, 8):
        x = words[a + at] ^ words[b + at]
        # The bits below the lowest that differs: all 64 of equal words.
        out[rows] = at + (np.bitwise_count(~x & (x - np.uint64(1))) >> 3)
        same = np.flatnonzero(x == 0)
        a, b, rows = a[same], b[same], rows[same]
        if not len(rows):
            break
    return np.minimum(out, _FAR)


class _Induction:
    """Pushes the suffixes one place to the left of those scanned, if of the wanted kind."""

    def __init__(self, t: np.ndarray, up: np.ndarray, rises: bool, symbols: int, lanes: Lanes):
        self._t, self._up, self._rises, self._lanes = t, up, rises, lanes
        # Of each lane the scan of its last tuple (-1: the lane is empty) and the smallest common prefix after it in that scan.
        self._last, self._rest = np.full(symbols, -1, np.int64), np.zeros(symbols, np.int16)
        # Scans and their smallest prefixes, without those that a later scan undercuts: first after a scan is the smallest since.
        self._scans: list[int] = []
        self._least: list[int] = []
        self._n = 0

    def scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        """positions in scanning order; common: with the one scanned before (0 across first symbols)."""
        before = positions - 1
        ok = before >= 0
        ok[ok] = self._up[before[ok]] == self._rises
        at = np.flatnonzero(ok)
        lane = self._t[before[at]]
        by = np.argsort(lane, kind="stable")
        lane, at = lane[by], at[by]
        found, begin = np.unique(lane, return_index=True)
        ends = [*begin[1:].tolist(), len(lane)][: len(found)]
        last, after = self._last[found].tolist(), self._rest[found].tolist()
        for c, was, rest, a, b in zip(found.tolist(), last, after, begin.tolist(), ends, strict=True):
            k = at[a:b]
            own = np.empty(b - a, np.int16)
            if was < 0:
                own[0] = 0
            else:
                since = bisect.bisect_right(self._scans, was)
                own[0] = 1 + min(rest, int(common[: k[0] + 1].min()), self._least[since] if since < len(self._least) else DEPTH)
            if b - a > 1:
                own[1:] = 1 + np.minimum.reduceat(common, k[:-1] + 1)[: b - a - 1]
                # The last of reduceat's spans reaches to the end; the one before it must stop at its tuple.
                own[-1] = 1 + int(common[k[-2] + 1 : k[-1] + 1].min())
            left = common[k[-1] + 1 :]
            self._last[c], self._rest[c] = self._n, left.min() if len(left) else _FAR
            self._lanes.push(c, before[k], np.minimum(own, _FAR))
        least = int(common.min()) if len(common) else DEPTH
        while self._least and self._least[-1] >= least:
            self._least.pop()
            self._scans.pop()
        self._scans.append(self._n)
        self._least.append(least)
        self._n += 1


def _induce(t: np.ndarray, up: np.ndarray, symbols: np.ndarray, seeds: Callable[[int], Chunks], limit: int, prefixes: bool) -> Chunks:
    """All suffixes in descending order, from LMS places per first symbol (ascending, with prefixes)."""
    run = (lambda at: _run(t, at)) if prefixes else (lambda at: 0)
    size = int(symbols[-1]) + 1
    queue, falling = Lanes(limit // 2), Lanes(limit // 2)
    induce = _Induction(t, up, False, size, queue)
    for c in symbols.tolist():
        end, fresh = None, True
        for positions, common in queue.pop(c):
            falling.push(c, positions, common)
            induce.scan(positions, common)
            end = positions[-1]
        for own, common in seeds(c):
            common = common.copy()
            if fresh:
                common[0], fresh = 0 if end is None else min(run(end), run(own[0])), False
            induce.scan(own, common)
    queue = Lanes(limit // 2)
    induce = _Induction(t, up, True, size, queue)
    for c in symbols[::-1].tolist():
        end = None
        if c == 0:
            queue.push(0, np.array([len(t) - 1]), np.zeros(1, np.int16))
        for positions, common in queue.pop(c):
            yield positions, common
            induce.scan(positions, common)
            end = positions[-1]
        carried = None
        for positions, common in falling.back(c):
            # A tuple's prefix is with its smaller neighbour; going down it belongs to that one.
            down = np.empty(len(positions), np.int16)
            down[1:] = common[:0:-1]
            down[0] = carried if carried is not None else 0 if end is None else min(run(end), run(positions[-1]))
            carried = common[0]
            yield positions[::-1], down
            induce.scan(positions[::-1], down)


def sorted_suffixes(t: np.ndarray, limit: int = MEMORY_TUPLES, prefixes: bool = True) -> Chunks:
    """(positions, common prefix with the one before), in descending order, in chunks.

    t: symbols of which the last is 0, the only 0; an array or a map of a file. With prefixes,
    symbols are bytes. Order and prefixes hold up to DEPTH symbols.
    """
    counts = np.zeros(1, np.int64)
    for a, b in _pieces(len(t)):
        own = np.bincount(t[a:b])
        counts = np.pad(counts, (0, max(0, len(own) - len(counts))))
        counts[: len(own)] += own
    symbols = np.flatnonzero(counts)
    up = rising(t, limit)
    lms = _lms(up, limit)
    if not len(lms):
        order = lms
    elif len(lms) <= limit:
        order = _order_in_memory(t, up, np.asarray(lms))
    else:
        order = _order_by_recursion(t, up, lms, symbols, limit)
    begin = np.zeros(len(counts) + 1, np.int64)
    for a, b in _pieces(len(lms)):
        begin[1:] += np.bincount(t[lms[a:b]], minlength=len(counts))
    begin = np.cumsum(begin)
    del lms
    padded = None
    if prefixes:
        padded = disk_array(len(t) + DEPTH + 16, np.uint8, limit)
        for a, b in _pieces(len(t)):
            padded[a:b] = t[a:b]

    def seeds(c: int) -> Chunks:
        for a, b in _pieces(int(begin[c + 1] - begin[c]), max(1, min(CHUNK_TUPLES, limit))):
            own = np.asarray(order[begin[c] + a : begin[c] + b])
            if not prefixes:
                yield own, np.zeros(len(own), np.int16)
                continue
            before = own[:1] if a == 0 else order[begin[c] + a - 1 : begin[c] + a]
            yield own, common_prefixes(padded, np.append(before, own[:-1]), own)

    yield from _induce(t, up, symbols, seeds, limit, prefixes)
