"""Removal of repeated passages by suffix sorting of the places that can repeat.

A byte goes if some string of LENGTH bytes around it also starts at another place. Sorting all
suffixes of a corpus would move every byte several hundred times over the network, so:

1. Each window of LENGTH bytes belongs to its anchor, the smallest of its K-gram hashes. Equal
   windows have equal anchors at equal offsets. Neighbouring windows with one anchor make a
   segment; it travels as two hashes.
2. Windows of an anchor that occurs once cannot repeat. Of the others, equal segments are
   counted and one of each goes on with its count.
3. Distinct segments meet by anchor in shards of about SHARD_BYTES; each shard's suffixes are
   sorted by induction with their common prefixes (see induced_sort). A window repeats if a
   neighbour shares LENGTH bytes with it, or if its segment was counted twice.
   An anchor of very many distinct segments (more than a HOT_SHARE of all, so there are at most
   HOT_SHARE of them) is split: its segments are cut again by further anchors of other hash
   functions, which equal windows share as well. What is left of it may make a shard far
   larger than memory; the sorter then works from disk.
4. Repeating windows go back to the documents by segment, and their bytes are cut out.

Every table in between is written to the shared folder; texts move once, those of documents
with repeats once more.
"""

from __future__ import annotations

import array
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, only
from .induced_sort import DEPTH, MEMORY_TUPLES, disk_array, sorted_suffixes
from .wordhash import _BASE, _TABLE, mix

LENGTH, K, SHARD_BYTES, CHUNK = 200, 80, 4 << 20, 1 << 19
HOT_SHARE, HOT_LEAST, SPLITS = 1000, 1000, 3
_PLACE = np.uint64((1 << 20) - 1)
assert LENGTH <= DEPTH


class Segmenter:
    """Segments of a text: anchor hash, digest of the bytes, first window, number of windows."""

    def __init__(self, length: int = LENGTH, k: int = K, salts: tuple[int, ...] = (0,)):
        self._n, self._k, self._salts = length, k, [np.uint64(x) for x in salts]
        self._pow = self._inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            n = max(n, 2 * len(self._pow))
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self._pow = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self._inv = np.multiply.accumulate(steps)

    @staticmethod
    def _lowest(v: np.ndarray, width: int) -> np.ndarray:
        """The smallest of each run of width values."""
        reach = 1
        while 2 * reach <= width:
            v = np.minimum(v[:-reach], v[reach:])
            reach *= 2
        return np.minimum(v[: len(v) - (width - reach)], v[width - reach :]) if width > reach else v

    def _chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self._k
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * self._pow[: len(raw)], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self._inv[: len(raw) - k + 1]
        anchor, changes = None, None
        for salt in self._salts:  # several hash functions: the anchors of all of them together
            h = mix(grams + salt)
            low = self._lowest((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), self._n - k + 1)
            new, own = np.append(True, low[1:] != low[:-1]), h[(low & _PLACE).astype(np.int64)]
            anchor, changes = (own, new) if anchor is None else (mix(anchor * np.uint64(_BASE) + own), changes | new)
        first = np.flatnonzero(changes)
        return anchor[first], first, np.diff(np.append(first, len(changes)))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        windows = len(raw) - self._n + 1
        parts = []
        for at in range(0, max(0, windows), CHUNK):
            anchors, first, count = self._chunk(raw[at : min(at + CHUNK, windows) + self._n - 1])
            parts.append((anchors, first + at, count))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        anchors, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        view, digest = memoryview(data), hashlib.blake2b
        told = b"".join(digest(view[a : a + c + self._n - 1], digest_size=8).digest() for a, c in zip(first.tolist(), count.tolist(), strict=True))
        return anchors.view(np.int64), np.frombuffer(told, np.int64), first.astype(np.int32), count.astype(np.int32)


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_py() or b""


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(length, k)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [_bytes(x) for x in part.column(2).cast(pa.large_binary())]
                lists = list(zip(*[segmenter(x) for x in texts], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                sizes = pa.array([len(x) for x in texts], pa.int64())
                whole = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
                columns = [part.column(0), part.column(1), sizes, whole, *[_lists(list(x), t) for x, t in zip(lists, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_bytes", "sha", "anchors", "digests", "starts", "counts"])

    return run


def _cut(length: int, k: int, hot: frozenset[int]):
    """Bytes of the listed segments of a text, with the key they are dealt by; those of hot anchors in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer = Segmenter(length, k, salts=tuple(0x632BE59BD9B4E019 * i & ((1 << 64) - 1) for i in range(1, SPLITS + 1)))
        for batch in batches:
            for i in range(batch.num_rows):
                data = _bytes(batch.column(0)[i].cast(pa.large_binary()))
                out: list[tuple] = []
                for r in batch.column(1)[i].as_py():
                    own = data[r["start"] : r["start"] + r["count"] + length - 1]
                    if r["a"] in hot:
                        keys, _, first, count = finer(own)
                        out += [(x, r["a"], r["s"], r["m"], f, own[f : f + c + length - 1]) for x, f, c in zip(keys.tolist(), first.tolist(), count.tolist(), strict=True)]
                    else:
                        out.append((r["a"], r["a"], r["s"], r["m"], 0, own))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "a", "s", "m", "first", "data"])

    return run


class ShardText:
    """The text of a shard as it streams in: bytes of the segments plus 1, each ended by 254, all ended by 0; on disk beyond the limit."""

    def __init__(self, limit: int):
        self._limit, self._held, self._file, self.size, self.ends = limit, bytearray(), None, 0, array.array("q")

    def add(self, data: bytes) -> None:
        self._held += data
        self._held.append(0xFD)
        self.size += len(data) + 1
        self.ends.append(self.size)
        if len(self._held) > self._limit:
            self._file = self._file or tempfile.TemporaryFile()  # noqa: SIM115  unlinked; its map below keeps it
            self._write()

    def _write(self) -> None:
        self._file.write((np.frombuffer(bytes(self._held), np.uint8) + np.uint8(1)).tobytes())
        self._held = bytearray()

    def symbols(self) -> np.ndarray:
        if self._file is None:
            return np.append(np.frombuffer(bytes(self._held), np.uint8) + np.uint8(1), np.uint8(0))
        self._write()
        self._file.write(b"\0")
        self._file.flush()
        return np.memmap(self._file, np.uint8, "r", shape=(self.size + 1,))


def twice(text: ShardText, length: int, limit: int = MEMORY_TUPLES) -> np.ndarray:
    """Of each place of the shard's text whether the length bytes from it on also start elsewhere in it."""
    t = text.symbols()
    out = disk_array(len(t), bool, limit)
    before = 0
    for positions, common in sorted_suffixes(t, limit):
        hit = common >= length
        out[positions[hit]] = True
        out[np.append(before, positions[:-1])[hit]] = True
        before = positions[-1]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _sort_shards(length: int, shard_bytes: int, limit: int):
    """Rows sorted by k, dealt to shards that end between two keys."""
    names = ("a", "s", "m", "first")

    def told(text: ShardText, rows: list[array.array]) -> Iterator[pa.RecordBatch]:
        flags, begin = twice(text, length, limit), 0
        for at in range(0, len(rows[0]), 4096):
            runs = []
            for end, m in zip(text.ends[at : at + 4096], rows[2][at : at + 4096], strict=True):
                own = np.asarray(flags[begin : max(begin, end - length)])
                runs.append(_runs(np.ones(len(own), bool) if m > 1 else own))
                begin = end
            first = rows[3][at : at + 4096]
            starts = [(r[0] + f).astype(np.int32) for r, f in zip(runs, first, strict=True)]
            columns = [pa.array(np.array(rows[i][at : at + 4096], np.int64)) for i in (0, 1)]
            columns += [_lists(starts, pa.int32()), _lists([r[1].astype(np.int32) for r in runs], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "s", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, rows, last = ShardText(limit), [array.array("q") for _ in names], None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("k")).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for i, (key, data) in enumerate(zip(keys, batch.column(batch.schema.get_field_index("data")), strict=True)):
                if key != last and text.size >= shard_bytes:
                    yield from told(text, rows)
                    text, rows = ShardText(limit), [array.array("q") for _ in names]
                last = key
                text.add(data.as_py())
                for r, c in zip(rows, columns, strict=True):
                    r.append(c[i])
        if text.size:
            yield from told(text, rows)

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = _bytes(batch.column(1)[i].cast(pa.large_binary()))
                cover = np.zeros(len(data) + 1, np.int32)
                for r in batch.column(2)[i].as_py():
                    cover[r["b"]] += 1
                    cover[r["e"] + length - 1] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                start, _ = _runs(gone)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((batch.column(0)[i].as_py(), int(gone.sum()), len(start), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["key", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, k: int = K, shard_bytes: int = SHARD_BYTES, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
    limit: int = MEMORY_TUPLES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and kept (the text) on demand.

    kept leaves out characters of which a cut left only some bytes; it is null where nothing
    was removed. A null text counts as empty. Texts under length bytes stay whole. Repeated
    rows are places of their own, so each loses what the other has. Null ids stay null. An
    empty table gives no rows. Other columns are not read.
    """
    spool = Spool(docs.sparkSession, "suffix")
    d = only(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    lists = "anchors array<long>, digests array<long>, starts array<int>, counts array<int>"
    schema = f"doc_id {dict(d.dtypes)['doc_id']}, key long, n_bytes long, sha string, {lists}"
    narrow = spool.put(d.mapInArrow(_anchors(length, k), schema), "anchors")
    # Written tables on both sides of joins, so that the planner can split the rows of a very common anchor.
    shared = narrow.select(F.explode_outer("anchors").alias("a")).groupBy("a").agg(F.count("*").alias("df")).filter("a is not null and df > 1").select("a")
    shared = spool.put(shared, "shared")
    places = narrow.select("key", F.explode_outer(F.arrays_zip("anchors", "digests", "starts", "counts")).alias("x"))
    places = places.select("key", F.col("x.anchors").alias("a"), F.col("x.digests").alias("s"), F.col("x.starts").alias("start"), F.col("x.counts").alias("count"))
    places = spool.put(places.join(shared, "a"), "places")
    distinct = places.groupBy("a", "s").agg(F.count("*").alias("m"), F.min(F.struct("key", "start", "count")).alias("r"))
    distinct = spool.put(distinct, "distinct")
    most = max(HOT_LEAST, distinct.count() // HOT_SHARE)
    hot = frozenset(r.a for r in distinct.groupBy("a").count().filter(F.col("count") > most).select("a").collect())  # HOT_SHARE rows at most
    wanted = distinct.select(F.col("r.key").alias("key"), F.struct("a", "s", "m", F.col("r.start").alias("start"), F.col("r.count").alias("count")).alias("x"))
    wanted = places.select("key").distinct().join(wanted.groupBy("key").agg(F.collect_list("x").alias("segments")), "key", "left")
    texts = spool.put(d.select("key", "text").join(wanted, "key"), "texts")
    segments = texts.filter(F.col("segments").isNotNull()).select("text", "segments")
    segments = segments.mapInArrow(_cut(length, k, hot), "k long, a long, s long, m long, first int, data binary")
    dealt = segments.repartition("k").sortWithinPartitions("k", "a", "s", "first")
    sorted_ = dealt.mapInArrow(_sort_shards(length, shard_bytes, limit), "a long, s long, at array<int>, n array<int>")
    runs = spool.put(sorted_.filter(F.size("at") > 0), "repeating")
    spool.drop("distinct")
    spool.drop("shared")
    spans = places.join(runs, ["a", "s"]).select("key", "start", F.explode_outer(F.arrays_zip("at", "n")).alias("x"))
    spans = spans.select("key", F.struct((F.col("start") + F.col("x.at")).alias("b"), (F.col("start") + F.col("x.at") + F.col("x.n")).alias("e")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))
    changed = texts.select("key", "text").join(spans, "key").mapInArrow(
        _removed(length), "key long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
    changed = (changed if with_text else changed.drop("kept")).dropDuplicates(["key"])
    out = narrow.select("doc_id", "key", "n_bytes", "sha").join(changed, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_text else []),
    )


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
