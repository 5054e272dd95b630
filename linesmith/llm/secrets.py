"""Secret scans through an inverted index of trigrams.

From each rule's regular expression a Boolean query of trigrams is derived that every match must satisfy. Each task indexes
the documents of a block by the trigrams that the rules ask for (folded to lower case), intersects and unites the postings
by each rule's query, and runs the expression only over the candidates. A rule without mandatory trigrams (hex digits) scans
every document. Documents are independent, so nothing is shuffled.

Cases: a null or empty text has no spans and the digest of the empty string; repeated rows keep one row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, Block, per_block

#: A query: True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
_MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    accept: Callable[[re.Match], bool] | None = None
    #: Finds the same matches (start, end) where the expression alone would read long runs again and again.
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def spans(self, regex: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
        if self.find is not None:
            return self.find(text)
        return (m.span() for m in regex.finditer(text) if self.accept is None or self.accept(m))


_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_JWT_END = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the rule jwt, looked for from its first dot: in the run before it the first `eyJ` is the leftmost start."""
    free, dot = 0, text.find(".eyJ")
    while dot >= 0:
        run = len(text[free:dot].rstrip(_RUN)) + free
        start = text.find("eyJ", run, dot)
        m = _JWT_END.match(text, dot) if 0 <= start <= dot - 11 else None
        if m:
            yield start, m.end()
        free = m.end() if m else dot + 1
        dot = text.find(".eyJ", free)


#: The base kinds first, in the order in which spans at one place are listed; then what the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", accept=lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of 24 or more are the runs `[0-9a-f]+` that pass
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", find=web_tokens),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", re.ASCII | re.IGNORECASE),
    Rule("login", r"[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)


def both(kind: str, parts: list) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not (kind == "and")]
    if kind == "or" and any(p is True for p in parts):
        return True
    return (kind == "and") if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: frozenset) -> Query:
    if any(len(s) < 3 for s in strings):
        return True
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(items) -> tuple[frozenset | None, Query]:
    """The strings that the sequence matches exactly, if they are few, and what any match contains."""
    whole, now, found = True, frozenset([""]), []
    for kind, value in items:
        exact, query = _item(kind, value)
        if exact is not None and len(now) * len(exact) <= _MOST_STRINGS:
            now = frozenset(a + b for a in now for b in exact)
        else:
            found += [_of_strings(now), query if exact is None else True]
            whole, now = False, exact if exact is not None else frozenset([""])
    return (now, _of_strings(now)) if whole else (None, both("and", [*found, _of_strings(now)]))


def _item(kind, value) -> tuple[frozenset | None, Query]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), True
    if kind is op.AT:
        return frozenset([""]), True
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(e is not None for e, _ in parts) and len(every := frozenset().union(*(e for e, _ in parts))) <= _MOST_STRINGS:
            return every, _of_strings(every)
        return None, both("or", [q for _, q in parts])
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
        return frozenset(chr(v).lower() for _, v in value), True
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if least == most == 1:
            return exact, query
        return None, query if least else True
    return None, True


@cache
def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """What of trigrams, in lower case, every text with a match holds."""
    return _sequence(parser.parse(pattern, flags))[1]


def _trigrams(query: Query) -> set[str]:
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of the documents of a block, for the trigrams that are asked for."""

    def __init__(self, wanted: set[str]) -> None:
        self.wanted = sorted(t for t in wanted if t.isascii())
        self.table = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 255 else np.uint16)
        for i, t in enumerate(self.wanted, 1):
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i

    def postings(self, b: Block) -> dict[str, np.ndarray]:
        d = LOWER[b.data].astype(np.int32)
        got = self.table[d[:-2] << 16 | d[1:-1] << 8 | d[2:]] if len(d) > 2 else np.zeros(0, np.uint8)
        at = np.flatnonzero(got)
        doc = np.searchsorted(b.off, at, "right") - 1
        pairs = np.unique(got[at].astype(np.int64) * b.n + doc)
        cut = np.searchsorted(pairs, np.arange(1, len(self.wanted) + 2) * b.n)
        return {t: pairs[cut[i] : cut[i + 1]] - (i + 1) * b.n for i, t in enumerate(self.wanted)}


def candidates(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Documents, in order, that satisfy a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(query, np.zeros(0, np.int64)) if query.isascii() else np.arange(n)
    parts = [candidates(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def _scanner(rules: tuple[Rule, ...], base: int):
    def run_all():
        compiled = [(re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags), r) for r in rules]
        index = Index(set().union(*(_trigrams(q) for _, q, _ in compiled)))

        def run(b: Block) -> pa.RecordBatch:
            postings = index.postings(b)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(b.n)]
            texts: dict[int, str] = {}
            for k, (regex, query, rule) in enumerate(compiled):
                for i in candidates(query, postings, b.n).tolist():
                    if (text := texts.get(i)) is None:
                        text = texts[i] = b.text_bytes(i).decode()
                    spans[i] += [(start, k, end) for start, end in rule.spans(regex, text)]
            names = [r.kind for r in rules]
            said = lambda found: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
            counts = [[sum(x[1] == k for x in found) for found in spans] for k in range(base)]
            spans = [sorted(found) for found in spans]
            sha = [hashlib.sha256(said([x for x in found if x[1] < base]).encode()).hexdigest() for found in spans]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array([said(x) for x in spans])], ["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

        return per_block(run)

    return lambda batches: run_all()(batches)


def scan_secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, by start, then kind)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{r.kind} long" for r in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(_scanner(BASE + tuple(added), len(BASE)), schema)
