"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (of 1 to MAX_N letters, words padded by a space) in rank order. A
document gets the language whose profile has the least out-of-place distance from the document's own profile: the sum, over
the document's n-grams, of the difference of ranks, or `top` for an n-gram that the language's profile lacks.

Learning counts n-grams of all training texts on the executors: each task adds up its counts, Spark sums them by language
and n-gram, and a window keeps the `top` of each language. Only these profiles (languages * top rows) go to the driver and,
with the tasks, to the executors. Ties in frequency go to the n-gram that is smaller by code points, ties in distance to the
language that is smaller as text.

Cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned; rows with
a null language or null text teach nothing; a null id counts as training; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import BLOCK_BYTES

MAX_N = 3
TOP = 300
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one space, with a space at either end."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[a]
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, a, 32)[keep].astype(np.int64)


def counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, smallest by code points first among equals, and their counts."""
    parts = [np.unique(_aligned(a, n), return_counts=True) for n in range(1, MAX_N + 1)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _aligned(a: np.ndarray, n: int) -> np.ndarray:
    """n-grams as 63-bit numbers that sort as the texts do by code points (shorter ones are filled up with zeros)."""
    return _grams(a, n) << 21 * (MAX_N - n)


def _grams(a: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of words with a space at either end; a space stands only at an end of an n-gram, and not alone."""
    if len(a) < n:
        return np.zeros(0, np.int64)
    m = len(a) - n + 1
    code, space = a[:m], a == 32
    for i in range(1, n):
        code = code << 21 | a[i : i + m]
    fine = ~space[:m] if n == 1 else np.ones(m, bool)
    for i in range(1, n - 1):
        fine &= ~space[i : i + m]
    if n == 2:
        fine &= ~(space[:m] & space[1 : 1 + m])
    return code[fine]


def ranked(g: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, in rank order."""
    if len(g) > top:
        least = np.partition(c, len(c) - top)[len(c) - top]
        some = c >= least
        g, c = g[some], c[some]
    return g[np.lexsort((g, -c))][:top]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language; what a task holds is bounded by the distinct n-grams, and is sent on when they are many."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def add() -> None:
        for lang, arrays in waiting.items():
            g, c = counted(np.concatenate(arrays))
            if lang in total:
                g, back = np.unique(np.concatenate([total[lang][0], g]), return_inverse=True)
                c = np.bincount(back, np.concatenate([total[lang][1], c])).astype(np.int64)
            total[lang] = g, c
        waiting.clear()

    def send() -> Iterator[pa.RecordBatch]:
        for lang, (g, c) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c.astype(np.int64))], ["lang", "g", "c"])
        total.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                waiting.setdefault(lang, []).append(letters(text))
                size += len(text)
                if size >= BLOCK_BYTES // 2:
                    add()
                    size = 0
                    if sum(len(g) for g, _ in total.values()) > 1 << 20:
                        yield from send()
    add()
    yield from send()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of every language: n-grams in rank order. At most languages * top rows reach the driver."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "g"))
    found: dict[str, list[int]] = {}
    for r in counts.withColumn("r", place).where(F.col("r") <= top).orderBy("lang", "r").collect():
        found.setdefault(r.lang, []).append(r.g)
    return {lang: np.array(g, np.int64) for lang, g in sorted(found.items())}


class Profiles:
    """Profiles ready for lookup: of each n-gram in any profile, its rank in every language (or `top`)."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.names, self.top = list(profiles), top
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for i, g in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.grams, g)] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        a = letters(text) if text else np.zeros(0, np.int64)
        if not self.names or not (a != 32).any():
            return UNDETERMINED, 0.0
        own = ranked(*counted(a), self.top)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        away = np.where(rank >= 0, np.abs(rank - np.arange(len(own))), self.top).sum(1)
        best = int(away.argmin())
        return self.names[best], 1.0 - float(away[best]) / (len(own) * self.top)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int = TOP) -> DataFrame:
    """The kept columns of every row, with lang_pred and score (1: all ranks agree, 0: no n-gram known)."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, top)
        for batch in batches:
            j = batch.schema.get_field_index("__text")
            said = [model.predict(t.as_py()) for t in batch.column(j)]
            columns = [c for i, c in enumerate(batch.columns) if i != j]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
