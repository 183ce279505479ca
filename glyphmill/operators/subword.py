"""What subword tokenizers are made of: pair counts, merges, longest and best segmentations, the Arrow map that encodes.

Merges are learned from all word types with their counts, not from the corpus. Few types are learned
from on the driver, more of them where they lie (learn). codec.py puts the parts together.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import word_counts

LONGEST_PIECE = 128


def pair_counts(docs: DataFrame) -> DataFrame:
    """a, b, cnt: neighbouring characters within words, weighted by word counts."""
    chars = word_counts(docs).select("cnt", F.array_remove(F.split("token", ""), "").alias("c"))
    pairs = F.zip_with(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = chars.select("cnt", F.explode_outer(pairs).alias("p")).filter("p is not null")
    return rows.groupBy("p.a", "p.b").agg(F.sum("cnt").alias("cnt"))


_PAIR = 1 << 31


def _weighed(keys: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Distinct keys with the sums of their weights."""
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, weights)
    return zip(own.tolist(), total.tolist(), strict=True)


def learn_merges(types: dict[str, int], size: int, split: Callable[[str], list[str]] = list, alphabet: list[str] | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Base symbols and merges of byte-pair encoding: the most frequent pair each time, ties by the pair.

    All types lie end to end in one array of symbol numbers (twelve bytes a symbol with its
    weight, beside the dictionary of types); a merge looks through it once and recounts only the pairs beside what it joins. The
    base is the given alphabet, else the symbols of the types.
    """
    words = sorted(types.items())  # split anew each time, so that no list of symbols per word is kept
    base = sorted({c for w, _ in words for c in split(w)}) if alphabet is None else list(alphabet)
    names = list(base)
    number = {c: i for i, c in enumerate(names)}
    lengths = np.fromiter((len(split(w)) + 1 for w, _ in words), np.int64, len(words))
    symbols = np.fromiter((x for w, _ in words for x in (*(number[c] for c in split(w)), -1)), np.int32, int(lengths.sum()))
    weights = np.repeat(np.array([n for _, n in words], np.int64), lengths)

    def pairs(at: np.ndarray) -> Iterator[tuple[int, int]]:
        at = at[(at >= 0) & (at + 1 < len(symbols))]
        left, right = symbols[at].astype(np.int64), symbols[at + 1].astype(np.int64)
        ok = (left >= 0) & (right >= 0)
        return _weighed(left[ok] * _PAIR + right[ok], weights[at[ok]])

    counts = dict(pairs(np.arange(len(symbols))))
    told = lambda k: (names[k // _PAIR], names[k % _PAIR])
    heap = [(-n, told(k), k) for k, n in counts.items()]  # entries of counts that have changed since are passed over
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while len(base) + len(merges) < size and heap:
        n, pair, key = heapq.heappop(heap)
        if counts.get(key) != -n:
            continue
        merges.append(pair)
        a, b = divmod(key, _PAIR)
        at = np.flatnonzero(symbols[:-1] == a)
        at = at[symbols[at + 1] == b]
        if a == b and len(at):  # of a run every second one
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        changed = set()
        for k, v in pairs(np.unique(np.concatenate([at - 1, at, at + 1]))):
            counts[k] -= v
            changed.add(k)
        joined = "".join(pair)
        if joined not in number:
            number[joined] = len(names)
            names.append(joined)
        symbols[at] = number[joined]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, weights = symbols[keep], weights[keep]
        at = at - np.arange(len(at))
        for k, v in pairs(np.unique(np.concatenate([at - 1, at]))):
            counts[k] = counts.get(k, 0) + v
            changed.add(k)
        counts.pop(key, None)
        for k in changed - {key}:
            if counts[k] > 0:
                heapq.heappush(heap, (-counts[k], told(k), k))
            else:
                del counts[k]
    return base, merges


#: The driver holds at most so many types, of so many characters. A block of types has about so many symbols. Merges foretold in a round, and made before blocks are written anew.
TYPES_ON_DRIVER, CHARS_ON_DRIVER, BLOCK_SYMBOLS, AHEAD, REWRITE = 20_000, 1 << 22, 1 << 20, 64, 64
#: Longer types are not foretold from. Tasks of a round for each core.
LONGEST_FORETOLD, TASKS = 200, 4


class Symbols:
    """Types end to end, a separator (-1) before, between and after them.

    A symbol's number stands at the places of its first and of its last base symbol (span: how
    many it has), so a merge moves nothing: neighbours are found by spans. Places are kept by
    symbol, so a merge looks at those of its rarer symbol only.
    """

    def __init__(self, first: np.ndarray, weights: np.ndarray, span: list[int]):
        """first: numbers by place, -2 inside of joined symbols; weights of the types."""
        self.first, self.last, self.span = first.copy(), first.copy(), np.array(span, np.int64)
        self.types = weights
        self.weights = np.append(weights, 0)[np.cumsum(first == -1) - 1]
        at = np.flatnonzero(first >= 0)
        self.last[at + self.span[first[at]] - 1] = first[at]
        self._by_symbol = at[np.argsort(first[at], kind="stable")]
        self._bounds = np.searchsorted(first[self._by_symbol], np.arange(len(span) + 1))
        self._joined: dict[int, list[np.ndarray]] = {}

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and weights of the pairs that begin at places of symbols."""
        left = self.first[at].astype(np.int64)
        right = self.first[at + self.span[left]].astype(np.int64)
        ok = right >= 0
        return left[ok] * _PAIR + right[ok], self.weights[at[ok]]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs(np.flatnonzero(self.first >= 0))

    def _before(self, at: np.ndarray) -> np.ndarray:
        left = self.last[at - 1]
        ok = left >= 0
        return at[ok] - self.span[left[ok]]

    def _places(self, a: int) -> np.ndarray:
        """Where a symbol stands, or stood before it was joined; in order."""
        parts = self._joined.get(a, [])
        if a + 1 < len(self._bounds):
            parts = [self._by_symbol[self._bounds[a] : self._bounds[a + 1]], *parts]
        return parts[0] if len(parts) == 1 else np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))

    def join(self, a: int, b: int, joined: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Merges a pair; keys and weights that this takes from pairs (negative) and adds to them."""
        if joined == len(self.span):
            self.span = np.append(self.span, self.span[a] + self.span[b])
        none, step = (np.zeros(0, np.int64), np.zeros(0, np.int64)), int(self.span[a])
        at, right = self._places(a), self._places(b)
        if len(at) <= len(right):
            at = at[self.first[at] == a]
            at = at[self.first[at + step] == b]
        else:
            right = right[self.first[right] == b]
            at = right[self.last[right - 1] == a] - step
        if a == b and len(at):  # of a run every second one
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=at[:1]) != step, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if not len(at):
            return none
        taken = self.pairs(np.unique(np.concatenate([self._before(at), at, at + step]))) if counted else none
        self.first[at + step], self.first[at] = -2, joined
        self._joined.setdefault(joined, []).append(at)
        self.last[at + step + self.span[b] - 1] = joined
        added = self.pairs(np.unique(np.concatenate([self._before(at), at]))) if counted else none
        return np.concatenate([taken[0], added[0]]), np.concatenate([-taken[1], added[1]])


def _numbered(words: list[str], number: dict[str, int], split: Callable[[str], list[str]], kind: type) -> np.ndarray:
    """Symbol numbers of types, each with a separator after it."""
    return np.fromiter((x for w in words for x in (*(number[c] for c in split(w)), -1)), kind)


def _blocks_of(number: dict[str, int], split: Callable[[str], list[str]], kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, weights, held = [], [], 0

        def block() -> pa.RecordBatch:
            raw = np.concatenate([np.array([-1], kind), *first]).tobytes(), np.concatenate(weights).astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], ["first", "weights"])

        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                first.append(_numbered(part.column(0).to_pylist(), number, split, kind))
                weights.append(part.column(1).to_numpy())
                held += len(first[-1])
                if held >= BLOCK_SYMBOLS:
                    yield block()
                    first, weights, held = [], [], 0
        if held:
            yield block()

    return run


def _opened(batches: Iterator[pa.RecordBatch], span: list[int], kind: type, made: list[tuple[int, int, int]]) -> Iterator[Symbols]:
    """Blocks after merges that were made since they were written."""
    for batch in batches:
        for raw, weights in zip(batch.column(0), batch.column(1), strict=True):
            block = Symbols(np.frombuffer(raw.as_buffer(), kind), np.frombuffer(weights.as_buffer(), np.int64), span)
            for m in made:
                block.join(*m, counted=False)
            yield block


def _rewritten(blocks: DataFrame, span: list[int], kind: type, made: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _opened(batches, span, kind, made):
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (x.first, x.types)], ["first", "weights"])

    return blocks.mapInArrow(run, "first binary, weights binary").persist(StorageLevel.DISK_ONLY)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct steps and keys with the sums of their weights, without those of sum 0."""
    step, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, step))
    step, key, n = step[order], key[order], n[order]
    new = np.flatnonzero(np.append(True, (step[1:] != step[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, new) if len(new) else n
    return step[new][n != 0], key[new][n != 0], n[n != 0]


def _changes(blocks: DataFrame, span: list[int], kind: type, made: list[tuple[int, int, int]], ahead: list[tuple[int, int, int]]) -> list[dict[int, int]]:
    """What each merge ahead changes of the counts of pairs; without any, the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in _opened(batches, span, kind, made):
            found = [x.join(*m) for m in ahead] if ahead else [x.all_pairs()]
            own = [_summed([(np.full(len(k), step, np.int32), k, v)]) for step, (k, v) in enumerate(found)]
            told = [_summed([*told, *own])]  # pairs of the alphabet and the merges
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in told[0]], ["step", "key", "n"])

    out: list[dict[int, int]] = [{} for _ in ahead or [0]]
    rows = blocks.mapInArrow(run, "step int, key long, n long").groupBy("step", "key").agg(F.sum("n").alias("n")).toArrow()
    for step, key, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        out[step][key] = n
    return out


def _foretold(counts: dict[int, int], names: list[str], number: dict[str, int], sample: Symbols, most: int) -> list[tuple[int, int, int]]:
    """The next merges, as the frequent types let expect what each of them changes; the first one is certain."""
    names, number, counts = list(names), dict(number), dict(counts)
    heap = [(-n, (names[k // _PAIR], names[k % _PAIR]), k) for k, n in counts.items()]
    heapq.heapify(heap)
    sample = Symbols(sample.first, sample.types, sample.span.tolist())
    ahead: list[tuple[int, int, int]] = []
    while heap and len(ahead) < most:
        n, pair, key = heapq.heappop(heap)
        if counts.get(key) != -n:
            continue
        joined = "".join(pair)
        if joined not in number:
            number[joined] = len(names)
            names.append(joined)
        ahead.append((*divmod(key, _PAIR), number[joined]))
        change = dict(_weighed(*sample.join(*ahead[-1])))
        scale = -n / max(1, -change.get(key, 0))
        counts.pop(key)
        for k, v in change.items():
            if k != key and v:
                counts[k] = round(counts.get(k, 0) + v * scale)
                heapq.heappush(heap, (-counts[k], (names[k // _PAIR], names[k % _PAIR]), k))
    return ahead


def learn(types: DataFrame, size: int, split: Callable[[str], list[str]] = list, alphabet: list[str] | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """As learn_merges, of types (token, cnt) that stay where they lie.

    A round foretells merges by frequent types and some of the others, has all blocks of types make them and tell what each
    changes, and takes them over as long as by the exact counts each is the next one. The driver
    holds the counts of pairs, that is of the alphabet and the merges, and about TYPES_ON_DRIVER types.
    """
    types = types.select("token", "cnt").persist(StorageLevel.DISK_ONLY)
    blocks = None
    try:
        n, chars = types.agg(F.count("*"), F.sum(F.char_length("token"))).first()
        if n <= TYPES_ON_DRIVER and (chars or 0) <= CHARS_ON_DRIVER:
            return learn_merges({r.token: r.cnt for r in types.collect()}, size, split, alphabet)
        words, weights = _foretold_from(types)
        base = sorted(r.c for r in _alphabet(types, split).collect()) if alphabet is None else list(alphabet)
        names, number = list(base), {c: i for i, c in enumerate(base)}
        span, kind = [1] * len(base), np.int16 if len(base) + size < 1 << 15 else np.int32
        blocks = types.coalesce(TASKS * types.sparkSession.sparkContext.defaultParallelism).mapInArrow(_blocks_of(number, split, kind), "first binary, weights binary").persist(StorageLevel.DISK_ONLY)
        first = np.concatenate([np.array([-1], kind), _numbered(words, number, split, kind)])
        sample = Symbols(first, weights, span)
        counts = _changes(blocks, span, kind, [], [])[0]
        types.unpersist()
        told = lambda k: (names[k // _PAIR], names[k % _PAIR])
        heap = [(-n, told(k), k) for k, n in counts.items()]
        heapq.heapify(heap)
        merges: list[tuple[str, str]] = []
        made, written, most = [], list(span), AHEAD
        while len(base) + len(merges) < size and counts:
            ahead = _foretold(counts, names, number, sample, min(most, size - len(base) - len(merges)))
            taken = 0
            for (a, b, joined), change in zip(ahead, _changes(blocks, written, kind, made, ahead), strict=True):
                while counts.get(heap[0][2]) != -heap[0][0]:
                    heapq.heappop(heap)
                key = a * _PAIR + b
                if heap[0][2] != key:
                    break
                merges.append(told(key))
                if joined == len(names):
                    number["".join(merges[-1])] = len(names)
                    names.append("".join(merges[-1]))
                    span.append(span[a] + span[b])
                sample.join(a, b, joined, counted=False)
                made.append((a, b, joined))
                counts.pop(key)
                for k, v in change.items():
                    if k != key:
                        counts[k] = counts.get(k, 0) + v
                        if counts[k] > 0:
                            heapq.heappush(heap, (-counts[k], told(k), k))
                        else:
                            del counts[k]
                taken += 1
                if not counts:
                    break
            most = min(AHEAD, max(8, 2 * taken))
            if len(made) >= REWRITE:
                before, blocks = blocks, _rewritten(blocks, written, kind, made)
                made, written = [], list(span)
                blocks.count()
                before.unpersist()
        return base, merges
    finally:
        types.unpersist()
        if blocks is not None:
            blocks.unpersist()


def _foretold_from(types: DataFrame) -> tuple[list[str], np.ndarray]:
    """About TYPES_ON_DRIVER types and their weights: the most frequent, and some of the others, which stand for all of these."""
    short = types.filter(F.char_length("token") <= LONGEST_FORETOLD)
    step = F.floor(8 * F.log2("cnt")).cast("int")
    room = TYPES_ON_DRIVER // 2
    least, left, rest = 1 << 30, room, 0
    for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 512 steps
        if rest or r.n > left:
            rest += r.n
        else:
            least, left = r.step, left - r.n
    every = max(1, -(-rest // room))
    chosen = short.filter((step >= least) | (F.pmod(F.xxhash64("token"), F.lit(every)) == 0))
    found = chosen.select("token", F.when(step >= least, F.col("cnt")).otherwise(F.col("cnt") * every).alias("cnt")).toArrow()
    return found.column("token").to_pylist(), found.column("cnt").to_numpy().astype(np.int64)


def _alphabet(types: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array({c for w in b.column(0).to_pylist() for c in split(w)}, pa.string())], ["c"])

    return types.mapInArrow(run, "c string").distinct()


class Trie:
    """Longest and all prefixes of a vocabulary. A search ends where no piece begins so, whatever the longest one is."""

    def __init__(self, pieces: dict[str, int | float]):
        self._of = pieces
        self._begun = {p[:n] for p in pieces for n in range(1, min(len(p), LONGEST_PIECE) + 1)}

    def prefixes(self, s: str, at: int, end: int | None = None) -> list[str]:
        """Pieces at a place, the shortest first, none beyond the end."""
        out = []
        for e in range(at + 1, (len(s) if end is None else end) + 1):
            p = s[at:e]
            if p not in self._begun:
                break
            if p in self._of:
                out.append(p)
        return out

    def longest(self, s: str, at: int, end: int | None = None) -> str | None:
        found = self.prefixes(s, at, end)
        return found[-1] if found else None


def longest_match(s: str, trie: Trie) -> list[str | None]:
    """From the left the longest piece each time; None (unknown) for a character of none."""
    out, at = [], 0
    while at < len(s):
        p = trie.longest(s, at)
        out.append(p)
        at += len(p) if p else 1
    return out


def best_pieces(s: str, trie: Trie, score: dict[str, float], unknown: float) -> list[str]:
    """The segmentation of greatest total score; single characters of no piece count as unknown."""
    best, back = [0.0] + [-math.inf] * len(s), [0] * (len(s) + 1)
    for at in range(len(s)):
        for p in trie.prefixes(s, at) or [s[at]]:
            v = best[at] + score.get(p, unknown)
            if v > best[at + len(p)]:
                best[at + len(p)], back[at + len(p)] = v, at
    out, end = [], len(s)
    while end:
        out.append(s[back[end] : end])
        end = back[end]
    return out[::-1]


def encode(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: an Arrow map; the factory runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder()
        for b in batches:
            ids = [code(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


class _Numbers(dict):
    """Chunks numbered as they come, with the ids of each: one after the other in pool, up to the ends."""

    def __init__(self, code: Callable[[str], list[int]]):
        self.code, self.pool, self.ends = code, array("i"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        self.pool.extend(self.code(chunk))
        self.ends.append(len(self.pool))
        self[chunk] = n = len(self.ends) - 2
        return n


def encode_chunks(docs: DataFrame, coder: Callable[[], tuple[Callable[[str], list[str]], Callable[[str], list[int]]]], key: str = "doc_id", text: str = "text", most: int = 200_000) -> DataFrame:
    """As encode, for ids that go by chunk: the factory gives the chunks of a text and the ids of a chunk.

    A task encodes a chunk once (and again after most others); texts are put together from arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, code = coder()
        known = _Numbers(code)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                if len(known) > most:
                    known = _Numbers(code)
                rows = [np.fromiter(map(known.__getitem__, chunks(x)), np.int32) if x else np.zeros(0, np.int32) for x in b.column(1).to_pylist()]
                pool, ends = np.array(known.pool, np.int32), np.array(known.ends, np.int64)
                number = np.concatenate(rows)
                begin, size = ends[number], ends[number + 1] - ends[number]
                upto = np.append(0, np.cumsum(size))
                ids = pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
                offsets = upto[np.append(0, np.cumsum([len(r) for r in rows]))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def _cached(code: Callable[[str], list[int]], most: int = 100_000) -> Callable[[str], list[int]]:
    kept: dict[str, list[int]] = {}

    def run(word: str) -> list[int]:
        if word not in kept:
            if len(kept) >= most:
                kept.clear()
            kept[word] = code(word)
        return kept[word]

    return run


def longest_matcher(vocab: dict[str, int]) -> Callable[[], Callable[[str], list[int]]]:
    """Greedy longest match over the whole text, blanks with the piece after them; unknown characters are 0."""

    def make() -> Callable[[str], list[int]]:
        trie = Trie(vocab)
        return lambda x: [vocab[p] if p else 0 for p in longest_match(x, trie)]

    return make


def segment_spans(text: str, starts: list[bool], trie: Trie) -> list[tuple[int, int]]:
    """Spans of pieces between given boundaries: a whole segment that is a piece, else the longest pieces within it.

    Flags that are missing are no boundaries; a character of no piece is a span.
    """
    cuts = [0, *(i for i, x in enumerate(starts[: len(text)]) if x and i), len(text)] if text else []
    spans = []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        at = begin
        while at < end:
            piece = trie.longest(text, at, end)
            spans.append((at, at + len(piece or " ")))
            at = spans[-1][1]
    return spans


def viterbi_spans(text: str, probabilities: list[float], trie: Trie, reward: float = 0.35, eps: float = 1e-6) -> list[tuple[int, int]]:
    """Spans of pieces (or single characters where none begins) of greatest total gain.

    A span from a to e gains log p[a] (unless a is 0), the logs of 1 - p over its inside, and
    the reward per character after its first; p is held within eps of 0 and 1, a missing one
    is a half. Ends are settled from the right, each offering its gain to the spans that reach
    it; of equal offers the shorter span stands.
    """
    n = len(text)
    p = [min(max(x, eps), 1 - eps) for x in probabilities[:n]]
    p += [0.5] * (n - len(p))
    inside = list(accumulate((math.log1p(-x) for x in p), initial=0.0))
    reaching: list[list[int]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for piece in trie.prefixes(text, start) or [text[start]]:
            reaching[start + len(piece)].append(start)
    gain, end_of = [-math.inf] * n + [0.0], [0] * n
    for end in range(n, 0, -1):
        for start in reaching[end]:
            offer = gain[end] + inside[end] - inside[start + 1] + reward * (end - start - 1) + (math.log(p[start]) if start else 0.0)
            if offer >= gain[start]:
                gain[start], end_of[start] = offer, end
    spans, at = [], 0
    while at < n:
        spans.append((at, end_of[at]))
        at = end_of[at]
    return spans
