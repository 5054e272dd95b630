"""Where an answer stands among the tokens that a model spelt it with."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters that fall away at the edges of a run, and how much longer than the answer a run may get.
EDGE, SLACK = " \n\"", 10


def _plain(text: str) -> tuple[str, list[int]]:
    """text without the backslashes that stand before quotes, and the place of each of its characters in text."""
    places = [i for i, c in enumerate(text) if not (c == "\\" and text[i + 1 : i + 2] in ("'", '"'))]
    return "".join(text[i] for i in places), places


def _occurrences(whole: str, part: str):
    at = whole.find(part)
    while at >= 0:
        yield at, at + len(part) - 1
        at = whole.find(part, at + 1)


def span(tokens: list[str], answer: str) -> tuple[int, int] | None:
    """The first and last place of the run of tokens that spells the answer: the earliest start, then the shortest.

    Spelt means: equal to the answer but for white space, or as long as the answer and equal but for case, once quotes are
    unescaped and blanks, line ends and double quotes are off the edges. Answers with such an edge of their own are never spelt,
    nor are those that the run outgrows by more than 10 characters on its way. The tokens are joined once and the answer is
    looked up in what they say, so the work is linear in them. A backslash at the end of an answer never stands for half of an
    escaped quote.
    """
    squeezed = "".join(answer.split())
    if not squeezed:
        return None
    owner = [i for i, t in enumerate(tokens) for _ in t]
    said, places = _plain("".join(tokens))
    solid = [i for i, c in enumerate(said) if not c.isspace()]
    hits = {(solid[a], solid[b]) for a, b in _occurrences("".join(said[i] for i in solid), squeezed)}
    hits |= set(_occurrences(_folded(said), _folded(answer)))
    # From each place, how far to the left only edges stand, and where the next character stands that is none.
    left, open_ = [], 0
    for i, c in enumerate(said):
        left.append(open_)
        open_ = open_ if c in EDGE else i + 1
    right, stop = [0] * len(said), len(said)
    for i in range(len(said) - 1, -1, -1):
        right[i] = stop
        stop = stop if said[i] in EDGE else i
    begins = {t: i for i, t in reversed(list(enumerate(owner)))}  # the first raw character of a token
    ends = {t: i for i, t in enumerate(owner)}
    found = []
    for a, b in hits:
        if said[a] in EDGE or said[b] in EDGE:
            continue
        first, last = owner[places[a]], owner[places[b]]
        before = places[left[a] - 1] if left[a] else -1  # the last raw character that is no edge
        after = places[right[b]] if right[b] < len(places) else None
        while first in begins and begins[first] <= before:
            first += 1  # this token says more than edges before the answer
        if first > owner[places[a]]:
            continue
        first = owner[before] + 1 if before >= 0 else 0
        end = ends[last]
        while _dangling(said, places, end) and (after is None or end < after) and end + 1 < len(owner):
            last = owner[end + 1]  # half of an escaped quote: the run needs its other half
            end = ends[last]
        if after is not None and after <= end:
            continue
        if _outgrown(said, places, owner, a, last, len(answer)):
            continue
        found.append((first, last))
    return min(found, default=None)


def _folded(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _dangling(said: str, places: list[int], end: int) -> bool:
    """Whether a run that ends at this raw character ends with the backslash of an escaped quote."""
    low, high = 0, len(places)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if places[mid] < end else (low, mid)
    return low == len(places) or places[low] != end


def _outgrown(said: str, places: list[int], owner: list[int], a: int, last: int, size: int) -> bool:
    """Whether the run had grown past its bound before its last token."""
    n = 0
    for i in range(a, len(places)):
        if owner[places[i]] >= last or n > size + 2 * SLACK:
            break
        n = i - a + 1 if said[i] not in EDGE else n
    return n > size + SLACK


def probability(tokens: list[str], logprobs: list[float | None], answer: str | None) -> float:
    """The mean probability of the tokens that spell the answer, between 0 and 1 with two decimals; 0 if none do. Tokens without a finite one are left out."""
    at = span(tokens, answer) if answer else None
    if at is None:
        return 0.0
    known = [math.exp(min(p, 0.0)) for p in logprobs[at[0] : at[1] + 1] if p is not None and not math.isnan(p)]
    return round(min(max(sum(known) / len(known), 0.0), 1.0), 2) if known else 0.0


@F.pandas_udf(DoubleType())
def confidence(answers: pd.Series, tokens: pd.Series, logprobs: pd.Series) -> pd.Series:
    """Points from 0 to 100 of answers, each beside the tokens and log probabilities of its own row."""
    none = lambda v: [] if v is None else list(v)
    rows = zip(answers, tokens, logprobs, strict=True)
    return pd.Series([round(probability([t or "" for t in none(ts)], none(ps), a) * 100, 2) for a, ts, ps in rows], dtype="float64")


def plain_confidences(answers: list[Column], tokens: Column, logprobs: Column) -> Column:
    """confidence() of each answer where one token is the whole answer and nothing else can spell it, as an expression; null where that is not plain.

    Plain means: all is printable ASCII without backslashes, the answer has no edge of its own and stands once in what the tokens say
    (white space and case apart), a token equals it, and the token before says more than edges. Then that token is the run.
    """
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  a value that is needed again
    bare = lambda c: F.lower(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))

    def points(p: Column) -> Column:
        sure = lambda x: F.when(F.abs(x - F.floor(x) - 0.5) > 1e-6, F.rint(x))  # noqa: E731  else the rounding is close
        return F.when(p.isNull() | F.isnan(p), 0.0).otherwise(let(F.exp(F.least(p, F.lit(0.0))) * 100, sure))

    def told(answer: Column, words: Column, said: Column) -> Column:
        once = lambda part: let(F.position(part, said), lambda at: (at > 0) & ~F.contains(F.substr(said, at + 1), part))
        run = lambda at: F.when((at == 1) | F.rlike(F.get(words, at - 2), F.lit(r'[^ \n"]')), F.when(let(bare(answer), once), let(F.get(logprobs.cast("array<double>"), at - 1), points)))
        return F.when(F.rlike(answer, F.lit(r"^[!#-~]([ -~\n]*[!#-~])?\z")), let(F.array_position(words, answer).cast("int"), lambda at: F.when(at > 0, run(at))))

    def all_told(words: Column) -> Column:
        every = lambda whole: F.when(F.rlike(whole, F.lit(r"^[ -\[\]-~\n]*\z")), let(bare(whole), lambda said: F.array(*(told(a, words, said) for a in answers))))
        return let(F.array_join(words, ""), every)

    none = F.array(*(F.lit(None).cast("double") for _ in answers))
    return F.coalesce(let(F.transform(tokens, lambda t: F.coalesce(t, F.lit(""))), all_told), none)
