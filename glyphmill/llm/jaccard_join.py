"""N-gram Jaccard join as a blocked sparse product of documents by shingles.

A document is a row of a 0/1 matrix with a column per distinct 4-word shingle; the product of
the matrix with its transpose holds all overlaps. It is never formed whole:

1. Rows that are equal are one class (copies cost nothing more).
2. A pair of Jaccard similarity t or more shares a column among the first n - ceil(t * n) + 1
   of either row, in any order of columns that is the same for all rows. The order here: a
   part of the columns, by hash, goes first, of them those of one class only, then by
   frequency. So the few columns that decide are rare ones, and frequencies of that part of the
   columns suffice (a fifth for t = 0.85: somewhat more than a row's deciding ones); a row whose
   first columns are its own has no partner.
3. Classes that share such a column, directly or through others, make a cluster. A cluster
   beyond BLOCK_SHINGLES is cut by size of row into bands; a row that is small enough to have
   a partner in the band below takes part there too, all other bands are excluded by the size
   bounds. Bands beyond BLOCK_SHINGLES are cut into blocks; each pair of these is one block of
   the product.
4. In a block, overlap counts of one row at a time accumulate from postings, pairs outside the
   size bounds are discarded, and rows already linked are skipped; so a group of very many near
   copies costs links, not pairs.
5. Links of all blocks are joined to components.

Rows are told apart by a key of their own, the hash of id and text, so null and repeated ids
take part like any other. Tables that meet very common keys are joined as written tables,
which lets the adaptive planner split the key's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, only, sifted
from .components import connected
from .wordhash import BLANKS, WordHasher, combine, mix, text_blocks

SHINGLE, PERCENT, BLOCK_SHINGLES = 4, 85, 2_000_000
_LOWER = bytes(range(256)).lower()


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, shingle: int = SHINGLE):
        self._words, self._k = WordHasher(BLANKS, _LOWER), shingle

    def block(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        h, at = self._words(raw)
        row = np.searchsorted(ends, at)
        n = np.bincount(row, minlength=len(ends))
        first = np.concatenate([[0], np.cumsum(n)])
        k, m = self._k, len(h) - self._k + 1
        grams = combine([h[i : i + m] for i in range(k)], k) if m > 0 else np.zeros(0, np.uint64)
        out = []
        for a, words in zip(first[:-1].tolist(), n.tolist(), strict=True):
            if words >= k:
                out.append(np.unique(grams[a : a + words - k + 1]))
            else:
                out.append(combine([h[a + i : a + i + 1] for i in range(words)], words) if words else np.zeros(0, np.uint64))
        return out

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, raw, ends in text_blocks(texts):
            yield from self.block(raw, ends)


def class_of(grams: np.ndarray) -> int | None:
    """One number for a set of shingles, whatever their order; none for no shingles."""
    return int(mix(np.array([mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))])).view(np.int64)[0]) if len(grams) else None


def first_columns(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def first_part(percent: int) -> int:
    """One of so many columns, by hash, goes first: a quarter more than the share that decides."""
    return max(2, int(0.8 / max(0.02, 1 - percent / 100) + 1e-9))


def _signatures(shingle: int, percent: int):
    part_of = np.uint64(first_part(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n, cid, early, lists = [], [], [], []
                for grams in shingler.column(part.column(1)):
                    is_first = grams % part_of == 0
                    own = grams[is_first]
                    if (lack := first_columns(len(grams), percent) - len(own)) > 0 and len(grams):
                        lists.append(np.concatenate([own, grams[~is_first][:lack]]))
                    else:
                        lists.append(own)
                    n.append(len(grams))
                    cid.append(class_of(grams))
                    early.append(len(own))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64)
                columns = [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(early, pa.int32())]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "n", "cid", "early", "grams"])

    return run


def link_block(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The component (by its first row) of each row, of links among the rows of a block."""
    n = np.array([len(s) for s in sets])
    group = np.full(len(sets), -1)
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    rest = len(sets)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        """Rows without a component, by column."""
        keep = group[rows] < 0
        order = np.argsort(columns[keep], kind="stable")
        return rows[keep][order], np.searchsorted(columns[keep][order], np.arange(columns.max() + 2))

    listed, edges = postings()
    built_for = rest
    for start in range(len(sets)):
        if group[start] >= 0:
            continue
        group[start], queue = start, [start]
        rest -= 1
        while queue and rest:
            x = queue.pop()
            if rest < built_for // 2:
                (listed, edges), built_for = postings(), rest
            own = columns[first[x] : first[x + 1]]
            low, high = edges[own], edges[own + 1]
            size = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            near, overlap = np.unique(listed[at], return_counts=True)
            fits = (group[near] < 0) & (100 * np.minimum(n[near], n[x]) >= percent * np.maximum(n[near], n[x]))
            near, overlap = near[fits], overlap[fits]
            linked = near[100 * overlap >= percent * (n[near] + n[x] - overlap)]
            group[linked] = start
            queue += linked.tolist()
            rest -= len(linked)
    return group


def _groups(batches: Iterator[pa.RecordBatch], keys: int, once: int | None = None) -> Iterator[pa.Table]:
    """Tables of equal values in the first key columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = last_once = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if once is not None:  # of rows that follow each other with equal keys and this column, only the first is held
            c = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (*range(keys), once)])
            fresh = np.append(True, (c[:, 1:] != c[:, :-1]).any(axis=0))
            fresh[0] = last_once is None or (c[:, 0] != last_once).any()
            last_once = c[:, -1]
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _link(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for t in _groups(batches, 3, once=3):
            expected = t.column("cid").to_pylist()
            sets, cids = [], []
            for cid, grams in zip(expected, shingler.column(t.column("text").combine_chunks()), strict=True):
                if class_of(grams) == cid and cid not in cids[-1:]:  # rows can repeat
                    sets.append(grams)
                    cids.append(cid)
            if len(sets) < 2:
                continue
            group = link_block(sets, percent)
            pairs = [(c, cids[g]) for c, g in zip(cids, group.tolist(), strict=True) if c != cids[g]]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _clusters(sigs: DataFrame, spool: Spool, percent: int) -> DataFrame:
    """cid, cluster of all classes with a possible partner."""
    known = sigs.filter(F.col("n") > 0)
    frequency = known.select("cid", F.explode_outer("grams").alias("gram")).groupBy("gram").agg(
        F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("df")
    )
    common = spool.put(frequency.filter(F.col("lo") != F.col("hi")).select("gram", "df"), "common")
    rows = known.select("cid", "n", "early", F.posexplode_outer("grams").alias("pos", "gram")).join(common, "gram")
    rows = rows.groupBy("cid", "gram").agg(*[F.first(c).alias(c) for c in ("n", "early", "pos", "df")])  # copies of a class, before they meet by it
    rows = rows.repartition("cid")
    is_early = (F.col("pos") < F.col("early")).alias("e")
    rows = rows.select("*", is_early)
    own = Window.partitionBy("cid", "e")
    rank = F.when(F.col("e"), F.col("early") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "gram")) - 1).otherwise(F.col("pos"))
    deciding = rows.withColumn("rank", rank).filter(F.col("rank") < F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1)
    deciding = spool.put(deciding.select("gram", "cid"), "deciding")
    spool.drop("common")
    leaders = spool.put(deciding.groupBy("gram").agg(F.min("cid").alias("leader"), F.count("*").alias("k")).filter("k > 1").drop("k"), "leaders")
    edges = deciding.join(leaders, "gram").filter("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    return connected(edges, spool, "clusters").select(F.col("node").alias("cid"), F.col("root").alias("cluster"))


def _cells(members: DataFrame, spool: Spool, percent: int) -> DataFrame:
    """cluster, i, j (a block of the product), cid, rk, n: where each class takes part."""
    wide = members.groupBy("cluster").agg(F.sum("n").alias("all")).filter(F.col("all") > BLOCK_SHINGLES)
    wide = spool.put(wide.select("cluster", F.lit(True).alias("wide")), "wide")
    m = members.join(wide, "cluster", "left")
    zero = F.lit(0).cast("long")
    whole = m.filter(F.col("wide").isNull()).select("cluster", zero.alias("i"), zero.alias("j"), "cid", "rk", "n")
    # A band's sizes grow by four times what partners can differ by, so about a quarter of its rows have partners below it.
    step = 4 * math.log(100 / min(percent, 99))
    band = F.floor(F.log(F.col("n").cast("double")) / step).cast("long")
    reaches_below = F.col("n") * (percent / 100) <= F.exp(F.col("own") * step) * (1 + 1e-9)
    m = m.filter(F.col("wide").isNotNull()).withColumn("own", band)
    m = m.withColumn("cell", F.explode(F.when(reaches_below, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    sized = m.groupBy("cluster", "cell").agg(F.sum("n").alias("weight"), F.max(F.col("own") == F.col("cell")).alias("lived"))
    sized = spool.put(sized.filter("lived").select("cluster", "cell", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("long").alias("nb")), "bands")
    m = m.join(sized, ["cluster", "cell"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")))
    m = m.withColumn("o", F.explode(F.sequence(zero, F.col("nb") - 1)))
    number = lambda x: F.shiftleft(F.col("cell"), 32) + x
    cut = m.select("cluster", number(F.least("b", "o")).alias("i"), number(F.greatest("b", "o")).alias("j"), "cid", "rk", "n")
    return whole.unionByName(cut)


def components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * |A & B| >= percent * |A or B| of their distinct shingles. A
    text of fewer words than a shingle is one shingle; a null text or one without words has
    none and links with nothing. component_id is the smallest id reachable by links; a null id
    stays null and takes part by its text, also as the only bridge between others; a component
    of null ids alone has none. Equal ids with other texts are documents of their own. Repeated
    rows are copies. An empty table gives no rows. Other columns are not read.
    """
    spool = Spool(docs.sparkSession, "jaccard")
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    id_type = dict(d.dtypes)["doc_id"]
    sigs = spool.put(d.mapInArrow(_signatures(shingle, percent), f"doc_id {id_type}, rk long, n long, cid long, early int, grams array<long>"), "signatures")
    clusters = spool.put(_clusters(sigs, spool, percent), "clusters")
    narrow = sigs.select("doc_id", "rk", "n", "cid")
    classes = narrow.filter(F.col("n") > 0).groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("n").alias("n"))
    classes = spool.put(classes, "classes")
    members = spool.put(classes.join(clusters, "cid").select("cid", "rk", "n", "cluster"), "members")
    cells = spool.put(_cells(members, spool, percent), "cells")
    # The comparison tells the planner that these keys are few, without which it makes no filter of them.
    texts = d.select("rk", "text").join(cells.filter("n > 0"), "rk").select("cluster", "i", "j", "cid", "text")
    dealt = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "cid")
    with sifted(spool.spark):  # most documents have no possible partner
        links = spool.put(dealt.mapInArrow(_link(shingle, percent), "a long, b long"), "links")
    roots = spool.put(connected(links, spool, "components").select(F.col("node").alias("cid"), "root"), "roots")
    keyed = spool.put(classes.join(roots, "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("key")), "keyed")
    least = spool.put(keyed.groupBy("key").agg(F.min("least").alias("component_id")), "least")
    labels = spool.put(keyed.join(least, "key").select("cid", "component_id"), "labels")
    for name in ("clusters", "members", "cells", "wide", "bands", "links", "roots", "keyed", "least", "classes", "deciding", "leaders"):
        spool.drop(name)
    out = narrow.join(labels, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return components(docs)
