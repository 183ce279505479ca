"""Text functions: Column to Column, all inside Catalyst unless marked Arrow.

Letters and digits are Unicode classes written out, since Java's shorthand classes are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters stripped from word edges.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„\"'`´…—–−"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The words that a first content word may not be.
SKIPPED_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "of", "for", "with", "by", "is", "are", "was", "it", "as", "if",
    "и", "в", "на", "с", "к", "у", "из", "за", "по", "о", "а", "но", "не", "что", "как", "это", "я", "он", "мы", "вы",
)
#: Pieces that end a sentence.
SENTENCE_ENDS = (".", "!", "?", "\n", "。", "！", "？")
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n"
SLOT = r"\s*\S+|\s+$"
SLOT_CUT = r"(?<=[.,!?/:;)\]}])(?=\p{L})"
#: A line end, a blank, a symbol or a digit alone; anything else in runs.
MORPH = r"\n| |[!-/:-@\[-`{-~]|[0-9]|[^\n !-/:-@\[-`{-~0-9]+"


def _empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def positions(first: Column | int, last: Column) -> Column:
    """first, first + 1, ..., last; empty where last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(_empty("int"))


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow: NFC form; there is no builtin."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def blank_words(c: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), "")


def slot_segments(c: Column) -> Column:
    """Words with the blanks before them, cut after punctuation that a letter follows."""
    return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(SLOT), F.lit(0)), lambda w: F.split(w, SLOT_CUT)))


def slot_chunks(c: Column, most: int) -> Column:
    """A word in chunks of at most so many characters."""
    n = F.greatest(F.char_length(c), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda i: F.substring(c, i * most + 1, most))


def slot_length(c: Column, most: int) -> Column:
    """How many chunks of at most so many characters the words of a text give."""
    parts = F.transform(slot_segments(c), lambda w: F.floor((F.greatest(F.char_length(w), F.lit(1)) - 1) / most) + 1)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def morph_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(MORPH), F.lit(0))


def merged_pieces(c: Column) -> Column:
    """The same pieces, where a blank joins the piece after it, whatever that is, pairwise from the left: one pass over the text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f" (?:{MORPH})|{MORPH}"), F.lit(0))


def edge_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGES))


def ascii_fold(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def similarity_percent(a: Column, b: Column) -> Column:
    """100 for two empty texts; else what the edit distance leaves of the longer one, in percent."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), (1 - F.levenshtein(a, b) / longer) * 100))


def cutoff(score: Column, least: float = 50.0) -> Column:
    return F.when(score >= least, score).otherwise(F.lit(0.0))


def first_content_word(c: Column) -> Column:
    """The first word of the first three lines that is not skipped; else the first one; else any word."""
    lines = F.slice(F.split(F.ltrim(F.regexp_replace(c, r"^\s+", "")), "\n"), 1, 3)
    stripped = F.transform(F.flatten(F.transform(lines, blank_words)), edge_strip)
    words = F.filter(stripped, lambda w: w.rlike(r"[\p{L}\p{N}]"))
    head = F.element_at(words, 1)
    long = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & (F.char_length(w) >= 3), i)), lambda i: i.isNotNull())
    skip_one = (F.char_length(head) == 1) & head.rlike(r"^\p{L}$") & (F.size(long) > 0)
    begin = F.when(skip_one, F.get(long, F.lit(0))).otherwise(F.lit(0))
    rest = F.slice(words, begin + 1, F.greatest(F.size(words), F.lit(1)))
    is_unknown = lambda w: F.lower(w).isin("<unk>", "[unk]")
    good = F.filter(rest, lambda w: ~is_unknown(w) & ~F.lower(w).isin(*SKIPPED_WORDS))
    fallback = F.element_at(rest, 1)
    chosen = F.when(F.size(good) > 0, F.get(good, F.lit(0))).when(is_unknown(fallback), F.lit("")).otherwise(fallback)
    any_word = F.regexp_extract(c, r"[\p{L}\p{N}_]+", 0)
    return F.when(F.size(words) > 0, chosen).otherwise(any_word)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in characters: agreement must hold from the start on."""
    n = F.least(F.char_length(a), F.char_length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y)
    at = F.array_position(pairs, False)
    return F.when(n <= 0, F.lit(0)).when(at == 0, n).otherwise(at - 1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound to a name: it is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """n-grams joined by blanks: each word and its followers side by side, so the cost grows with the words alone."""

    def build(w: Column) -> Column:
        out = w
        for k in range(1, n):
            out = F.zip_with(out, F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(w) >= n, F.slice(out, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))).otherwise(_empty())

    return let(words, build)


def quality_flag(c: Column, min_chars: int = 12, min_letters: int = 4) -> Column:
    """What is wrong with a continuation, null if nothing."""
    n = F.char_length(F.regexp_replace(c, r"^\s+|\s+$", ""))
    letters = F.regexp_count(c, F.lit(r"[\x{0400}-\x{04FF}a-zA-Z]"))
    return (
        F.when(F.instr(c, "�") > 0, F.lit("replacement_char_U+FFFD"))
        .when(n < min_chars, F.concat(F.lit("too_short(len="), n.cast("string"), F.lit(f"<{min_chars})")))
        .when(letters < min_letters, F.concat(F.lit("too_few_letters("), letters.cast("string"), F.lit(f"<{min_letters})")))
    )


def looks_mangled(c: Column) -> Column:
    """Characters that UTF-8 read as a one-byte code page leaves behind."""
    return c.rlike("[ÐÑРСЃЌўџ]")


@F.pandas_udf(StringType())
def unmangle(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow: text as it was before UTF-8 was read as a one-byte code page; unchanged if it was not."""

    def fix(x: str | None) -> str | None:
        for page in ("cp1251", "latin-1"):
            try:
                return None if x is None else x.encode(page).decode("utf-8")
            except UnicodeError:
                continue
        return x

    for s in batches:
        yield s.map(fix)


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Escapes in the order in which they apply.
LABEL_ESCAPES = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("_", "\\_"), ("#", "\\#"))
BODY_ESCAPES = (
    ("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("_", "\\_"),
    ("^", "\\textasciicircum{}"), ("~", "\\textasciitilde{}"), ("\r\n", "\n"), ("\r", "\n"), ("\n", " \\newline "),
)


def tex_label(c: Column) -> Column:
    return _replaced(c, LABEL_ESCAPES)


def tex_body(c: Column) -> Column:
    return _replaced(F.coalesce(c, F.lit("")), BODY_ESCAPES)


def ellipsis(c: Column, most: int = 150) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def detokenize(tokens: Column) -> Column:
    """Words with blanks between, none before full stops, commas and line ends."""
    return _replaced(F.array_join(tokens, " "), ((" .", "."), (" ,", ","), (" \n", "\n")))


def join_prompt(prompt: Column, target: Column) -> Column:
    """Prompt and target with one blank between."""
    a, b = F.rtrim(prompt), F.ltrim(target)
    return F.when(F.char_length(a) == 0, b).when(F.char_length(b) == 0, a).otherwise(F.concat_ws(" ", a, b))


def continuation(full: Column, prefix: Column) -> Column:
    """What a text adds to its prefix; all of it where it has another beginning."""
    return F.when(F.startswith(full, prefix), F.substring(full, F.char_length(prefix) + 1, F.char_length(full))).otherwise(full)
