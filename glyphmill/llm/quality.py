"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words are runs between blanks; with each word goes its shape (letters, digits and cases
collapsed), which makes n-grams of shapes. N-grams hash into 2^BITS buckets; a text's score is
the logistic of the sum of its weights over the square root of the number of its n-grams.
Training reads at most MAX_ROWS labelled rows, those of smallest hash of id (documented bound);
scoring reads every whole text once and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only
from .wordhash import BLANKS, WordHasher, combine, text_blocks

BITS, MAX_ROWS, EPOCHS, THRESHOLD = 18, 6000, 3, 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0, 1e-4
_SEPARATORS = BLANKS
#: Shapes: A for capitals, a for other letters (all bytes beyond ASCII), 0 for digits; others as they are.
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


class Features:
    """Buckets of the n-grams of each text of a block, and where each text begins among them."""

    def __init__(self, bits: int = BITS):
        self._shift = np.uint64(64 - bits)
        self._words = WordHasher(_SEPARATORS)
        self._shapes = WordHasher(_SEPARATORS)

    @staticmethod
    def _collapsed(raw: np.ndarray) -> np.ndarray:
        """Shape bytes without repeats of the byte before."""
        codes = np.frombuffer(_SHAPES, np.uint8)[raw]
        keep = np.ones(len(codes), bool)
        keep[1:] = codes[1:] != codes[:-1]
        return codes[keep]

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, at = self._words(raw)
        s, _ = self._shapes(self._collapsed(raw))
        row = np.searchsorted(ends, at)
        same = row[1:] == row[:-1]
        again = same & (h[1:] == h[:-1])
        grams = [
            (combine([h], 1), row), (combine([h[:-1], h[1:]], 2)[same], row[1:][same]), (combine([s], 3), row),
            (combine([s[:-1], s[1:]], 4)[same], row[1:][same]), (np.full(int(again.sum()), 5 << 40, np.uint64), row[1:][again]),
        ]
        bucket = np.concatenate([(g >> self._shift).astype(np.int64) for g, _ in grams])
        rows = np.concatenate([r for _, r in grams])
        order = np.argsort(rows, kind="stable")
        return bucket[order], np.searchsorted(rows[order], np.arange(len(ends) + 1))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values: counts over the square root of the number of n-grams."""
    own, counts = np.unique(buckets, return_counts=True)
    return own.astype(np.int32), (counts / np.sqrt(max(1, len(buckets)))).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader; the last one is the bias.

    examples: sparse() of a text and its label. Without examples all weights are zero.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            own, x, label = examples[i]
            own, x = np.append(own, 1 << bits), np.append(x, np.float32(1))
            w = _weights(z[own], n[own])
            g = (_logistic(w @ x) - label) * x
            sigma = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
            z[own] += g - sigma * w
            n[own] += g * g
    return _weights(z, n).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees (a null id is in it)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def _featurize(bits: int):
    """The last column, a text, becomes its distinct buckets and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            last = batch.num_columns - 1
            for a, b, raw, ends in text_blocks(batch.column(last)):
                bucket, starts = features(raw, ends)
                own, values = zip(*[sparse(bucket[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)], strict=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (own, values)]
                kept = [c.slice(a, b - a) for c in batch.columns[:last]]
                yield pa.RecordBatch.from_arrays([*kept, *lists], [*batch.schema.names[:last], "own", "x"])

    return run


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        own, x = (batch.column(batch.schema.get_field_index(c)) for c in ("own", "x"))
        examples += [(np.asarray(o.values), np.asarray(v.values), y) for o, v, y in zip(own, x, batch.column(0).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([train(examples).tobytes()], pa.binary())], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from at most max_rows labelled rows outside the held-out fold; conflicting labels of an id count each.

    Texts become features where they lie; one task, over the bounded rows in an order that
    does not depend on how they are dealt, trains, and only the weights come to the driver.
    """
    d = only(docs, doc_id=id_col, text=text_col)
    known = only(labels, doc_id=id_col, label=label_col).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = d.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int"), F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("t"), "text")
    rows = rows.mapInArrow(_featurize(BITS), "label int, o long, t long, own array<int>, x array<float>")
    got = rows.orderBy("o", "t", "label").limit(max_rows).coalesce(1).mapInArrow(_train, "weights binary").collect()  # ids can repeat in docs
    return np.frombuffer(got[0].weights, np.float32) if got else train([])


def _scores(weights: np.ndarray, bits: int, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            scores = []
            for first, last, raw, ends in text_blocks(batch.column(batch.schema.get_field_index(text))):
                bucket, starts = features(raw, ends)
                sums = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
                size = np.maximum(1, starts[1:] - starts[:-1])
                scores.append(_logistic((sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(size) + weights[-1]))
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), found], [*keep, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and score, 0 to 1.

    A null text scores as an empty one: by the bias alone. A score column of docs is replaced.
    Repeated rows score each; an empty table gives no rows.
    """
    cols = [c for c in (keep or docs.columns) if c != "score"]
    d = docs.select(*[docs[c] for c in dict.fromkeys([*cols, text_col])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in cols)
    return d.mapInArrow(_scores(weights, BITS, text_col, cols), f"{schema}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of THRESHOLD)."""
    out = score(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
