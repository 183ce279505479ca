"""Operators on texts and pairs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from ..functions import text as t


#: Types as objects: executors import this module without a session, which strings would need.
_LOOP = StructType().add("is_loop", BooleanType()).add("words", IntegerType()).add("kept", IntegerType())


def prompt_answers(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, answer: user turns with the assistant turn that follows."""
    a = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    b = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"])


def prompt_targets(items: DataFrame) -> DataFrame:
    """item_id, prompt, target: the last word is the target."""
    w = t.blank_words(F.col("text"))
    return items.select("item_id", w.alias("w")).select(
        "item_id", F.array_join(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), " ").alias("prompt"), F.coalesce(F.get("w", F.size("w") - 1), F.lit("")).alias("target")
    )


def finite(c: Column) -> Column:
    """A number if the text is a finite one, else null."""
    v = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists, a row at a time with running minima."""
    if not a or not b:
        return len(a) + len(b)
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([code[w] for w in b])
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a, 1):
        change = np.minimum(row[1:] + 1, row[:-1] + (y != code[w]))
        row = np.minimum.accumulate(np.concatenate([[i], change]) - steps) + steps
    return int(row[-1])


@F.pandas_udf(IntegerType())
def word_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Arrow: edit distance of the words of two texts, edges stripped, in lower case."""

    def words(x: str | None) -> list[str]:
        return [s.lower() for w in (x or "").split() if (s := w.strip(t.EDGES))]

    for a, b in batches:
        yield pd.Series([distance(words(x), words(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def trimmed(df: DataFrame, keys: list[str], n: int = 3, most: int = 2, least_words: int = 12, text: str = "text") -> DataFrame:
    """keys, text, trimmed: cut before the first n-gram, from word least_words on, met more than most times; else the text as it is.

    Running counts per n-gram by a window, so a long text costs a sort and no nested loop.
    """
    w = df.select(*keys, F.col(text).alias("_text"), t.blank_words(F.col(text)).alias("w"))
    grams = w.select(*keys, F.posexplode_outer(t.ngrams(F.col("w"), n)).alias("i", "gram")).filter("gram is not null")
    seen = F.count("*").over(Window.partitionBy(*keys, "gram").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    first = grams.withColumn("seen", seen).filter((F.col("seen") > most) & (F.col("i") + n >= least_words)).groupBy(*keys).agg(F.min("i").alias("keep"))
    j = w.join(first, keys, "left")
    cut = F.coalesce(F.col("keep") >= least_words, F.lit(False))
    return j.select(*keys, F.when(cut, F.array_join(F.slice("w", F.lit(1), F.greatest("keep", F.lit(1))), " ")).otherwise(F.col("_text")).alias("text"), cut.alias("trimmed"))


def tail_loop(units: np.ndarray, least_prefix: int, most_period: int) -> int | None:
    """Where the longest tail begins that is one pattern three times or more, after the prefix.

    For a period p, the tail repeats as far back as units equal those p places on; so one
    comparison per period gives the number of repeats at once.
    """
    n = len(units)
    best = None
    for p in range(1, min(most_period, n // 3) + 1):
        equal = units[:-p] == units[p:]
        differing = np.flatnonzero(~equal)
        run = n - p - (differing[-1] + 1 if len(differing) else 0)  # places from the end that repeat
        repeats = min(run // p + 1, (n - least_prefix) // p)
        if repeats >= 3 and (best is None or n - p * repeats < best):
            best = n - p * repeats
    return best


def loop_of(text: str) -> tuple[bool, int, int]:
    """Whether a text ends in a loop, its words, and the words before the loop."""
    words = text.split()
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    by_word = tail_loop(np.array([code[w] for w in words]), 8, 32) if len(words) >= 11 else None
    flat = " ".join(words)
    by_char = tail_loop(np.array([ord(c) for c in flat]), 32, 80) if len(flat) >= 35 else None
    starts = [x for x in (by_word, None if by_char is None else len(flat[:by_char].split())) if x is not None]
    return (True, len(words), min(*starts, len(words))) if starts else (False, len(words), len(words))


@F.pandas_udf(_LOOP)
def loop_start(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Arrow: loop_of each text."""
    for s in batches:
        yield pd.DataFrame([loop_of(x or "") for x in s], columns=["is_loop", "words", "kept"])
