"""Array functions over token ids, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import positions

IGNORED = -100


def add_specials(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def pad_right(ids: Column, length: int, pad: int) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(cut)).cast("int")))


def pad_left(ids: Column, length: int, pad: int) -> Column:
    """Keeps the tail."""
    cut = tail(ids, length)
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(cut)).cast("int")), cut)


def tail(ids: Column, length: int) -> Column:
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - (length - 1)), length)


def mask_of(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def labels_of(ids: Column, pad: int) -> Column:
    """Next-token labels: shifted by one, padding ignored."""
    return F.slice(F.transform(ids, lambda x: F.when(x == pad, IGNORED).otherwise(x)), 2, F.greatest(F.size(ids), F.lit(1)))


def smart_split(ids: Column, most: int, ends: Column | list[int]) -> Column:
    """Tokens to keep of a longer list: up to the last sentence end within the window of 199 places before the limit."""
    ends = ends if isinstance(ends, Column) else F.array(*[F.lit(e) for e in ends]).cast("array<int>")
    window = positions(max(1, most - 199), F.lit(most - 1))  # places counted from 0
    found = F.array_max(F.filter(window, lambda i: F.array_contains(ends, F.get(ids, i))))
    return F.when(F.size(ids) <= most, F.size(ids)).otherwise(F.coalesce(found + 1, F.lit(most)))


def trim_pads(ids: Column, pad: int) -> Column:
    """Without leading padding, cut at the first padding after that."""
    real = F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull())
    begin = F.get(real, F.lit(0))
    rest = F.slice(ids, begin + 1, F.greatest(F.size(ids), F.lit(1)))
    stop = F.array_position(rest, pad)
    kept = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
    return F.when(F.size(real) == 0, F.array().cast("array<int>")).otherwise(kept)


def pad_slots(slots: Column, words: int, width: int, pad: int) -> Column:
    """Lists of character ids in a rectangle: so many words of so many ids."""
    full = F.transform(F.slice(slots, 1, words), lambda w: pad_right(w, width, pad))
    blank = F.array_repeat(F.array_repeat(F.lit(pad), width), F.greatest(F.lit(0), words - F.size(full)).cast("int"))
    return F.concat(full, blank)


def boundary_masks(starts: Column, length: Column) -> tuple[Column, Column]:
    """Flags of places that begin a segment, and of places inside one."""
    at = positions(0, length - 1)
    return F.transform(at, lambda i: F.array_contains(starts, i).cast("int")), F.transform(at, lambda i: (~F.array_contains(starts, i)).cast("int"))


def segment_penalty(rows: DataFrame, key: str, least: int) -> DataFrame:
    """penalty of rows (key, seg, pos, x, p): over segments whose ids occur less than so often, the p of a start but a row's first, and 1 - p inside."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "x", "p")))  # a segment is a word
    s = rows.groupBy(key, "seg").agg(parts.alias("a")).withColumn("piece", F.transform("a", lambda e: e["x"]))
    known = s.groupBy("piece").count().filter(F.col("count") >= least).select("piece")
    costs = F.transform("a", lambda e, i: F.when(i > 0, 1 - e["p"]).when(e["pos"] > 0, e["p"]).otherwise(0.0))
    out = s.join(known, "piece", "left_anti").agg(F.sum(F.aggregate(costs, F.lit(0.0), lambda u, v: u + v)).alias("total"))
    return out.crossJoin(rows.agg(F.count("*").alias("n"))).select((F.coalesce("total", F.lit(0.0)) / F.greatest(F.lit(1), F.col("n"))).alias("penalty"))  # one row each
