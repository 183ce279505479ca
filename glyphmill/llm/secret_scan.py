"""Secret scans over a trigram inverted index.

Each rule's regex is parsed into a Boolean query of trigrams that any match must hold. Each
block of texts gets an inverted index of the trigrams that some query names (over lower-cased
bytes); postings are intersected and united, and only the candidates of a rule are verified
with its regex. Rules without a mandatory trigram scan all texts. The index lives and dies
with its block, so nothing is shuffled and memory is bounded by a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only
from .wordhash import text_blocks

BLOCK_BYTES = 2 << 20
#: No more strings than this are followed side by side through a regex.
_EXACT = 64
ALL = None


@dataclass(frozen=True)
class Rule:
    """group and least: the group that must have so many characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed patterns of the three base kinds (in the order in which equal starts are listed), then those that this scan adds.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _all_of(*parts):
    flat = [p for p in dict.fromkeys(parts) if p is not ALL]
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _any_of(*parts):
    return ALL if not parts or any(p is ALL for p in parts) else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _of_strings(strings: set[str]):
    """Any of the strings: all trigrams of one of them."""
    return _any_of(*[_all_of(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(item) -> set[str] | None:
    """The few lower-cased strings that an element stands for, if it stands for few."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        if all(o is C.LITERAL and v < 128 for o, v in arg) and len(arg) <= _EXACT:
            return {chr(v).lower() for _, v in arg}
        return None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, sub = arg
        one = _exact_sequence(sub) if high is not C.MAXREPEAT and high <= 16 else None
        if one is None:
            return None
        out, last = (set() if low else {""}), {""}
        for n in range(1, int(high) + 1):
            last = {a + b for a in last for b in one}
            if n >= low:
                out |= last
            if len(out) + len(last) > _EXACT:
                return None
        return out
    if op is C.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is C.BRANCH:
        parts = [_exact_sequence(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    return {""} if op is C.AT else None


def _exact_sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        e = _exact(item)
        if e is None or len(out) * len(e) > _EXACT:
            return None
        out = {a + b for a in out for b in e}
    return out


def _query(items):
    """What every match of a sequence must hold; ALL if nothing is known."""
    need, run = [], {""}
    for item in items:
        op, arg = item
        e = _exact(item)
        if e is not None and len(run) * len(e) <= _EXACT:
            run = {a + b for a in run for b in e}
            continue
        need.append(_of_strings(run))
        run = {""} if e is None else e
        if e is None and op is C.SUBPATTERN:
            need.append(_query(arg[3]))
        elif e is None and op is C.BRANCH:
            need.append(_any_of(*[_query(x) for x in arg[1]]))
        elif e is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            need.append(_query(arg[2]))
    return _all_of(*need, _of_strings(run))


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams: a string, ("and", ...), ("or", ...) or ALL.

    Every text with a match of the pattern satisfies it. Of texts, letters A-Z are lowered.
    """
    return _query(parser.parse(pattern))


def _trigrams(query) -> set[str]:
    return set() if query is ALL else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


class Index:
    """Postings, per named trigram, of the rows of a block that hold it."""

    def __init__(self, trigrams: list[str]):
        self._number = {t: i for i, t in enumerate(trigrams)}
        self._slot = np.zeros(1 << 24, np.uint16)
        for t, i in self._number.items():
            a, b, c = t.encode("ascii")
            self._slot[a << 16 | b << 8 | c] = i + 1
        self._lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)

    def build(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        x = self._lower[raw].astype(np.uint32)
        if len(x) < 3:
            return {}
        slot = self._slot[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        at = np.flatnonzero(slot)
        pairs = np.unique(slot[at].astype(np.int64) << 32 | np.searchsorted(ends, at))
        edges = np.searchsorted(pairs >> 32, np.arange(1, len(self._number) + 2))
        return {i: pairs[edges[i] : edges[i + 1]] & 0xFFFFFFFF for i in range(len(self._number))}

    def rows(self, postings: dict[int, np.ndarray], query, n: int) -> np.ndarray:
        if query is ALL:
            return np.arange(n)
        if isinstance(query, str):
            return postings.get(self._number[query], np.zeros(0, np.int64))
        parts = [self.rows(postings, q, n) for q in query[1:]]
        merge = np.intersect1d if query[0] == "and" else np.union1d
        out = parts[0]
        for p in parts[1:]:
            out = merge(out, p)
        return out


def find(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, without those of too few characters (code points)."""
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _quick(rule: Rule) -> re.Pattern:
    """For a class repeated without end: its runs of at least the wanted length, without the many short ones."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return re.compile(rule.pattern)


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = Index(sorted(set().union(*map(_trigrams, queries))))
        regexes = [_quick(r) for r in rules]
        for batch in batches:
            for first, last, raw, ends in text_blocks(batch.column(1), BLOCK_BYTES):
                n = last - first
                postings = index.build(raw, ends)
                spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                texts: dict[int, str] = {}
                for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries, strict=True)):
                    for i in index.rows(postings, query, n).tolist():
                        if i not in texts:
                            texts[i] = batch.column(1)[first + i].as_py() or ""
                        spans[i] += [(a, k, b) for a, b in find(rule, regex, texts[i])]
                yield _rows(batch.column(0).slice(first, n), spans, rules)

    return run


def _rows(ids: pa.Array, spans: list[list[tuple[int, int, int]]], rules: tuple[Rule, ...]) -> pa.RecordBatch:
    told = [[(rules[k], f"{rules[k].kind}:{a}:{b}") for a, k, b in sorted(own)] for own in spans]
    base = [[r for r, _ in own if r.base] for own in told]
    counts = [pa.array([sum(r.kind == kind for r in own) for own in base], pa.int64()) for kind in ("assign", "access", "hex")]
    digest = [hashlib.sha256(",".join(s for r, s in own if r.base).encode()).hexdigest() for own in told]
    columns = [ids, *counts, pa.array(digest, pa.string()), pa.array([",".join(s for _, s in own) for own in told], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind).

    Positions are code points, ends exclusive. A null text counts as empty: no spans, the digest
    of nothing. Repeated rows and null ids give their rows; an empty table none. Other columns
    are not read.
    """
    d = only(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {dict(d.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return d.mapInArrow(_scan(rules), schema)


def report(docs: DataFrame) -> DataFrame:
    return scan(docs)
