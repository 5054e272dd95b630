"""Ordinal quality classifier: cumulative links over shared hashed-text weights.

A document's grade y in 0..K-1 has P(y <= k) = sigmoid(threshold_k - w.x), with one weight vector w for all grades and ordered
thresholds. x marks the hashed words of the text (letters and digits, ASCII lower case) and the beginnings of its longer words,
which words of one stem share, and holds some shares of its layout (symbols, capitals, repeats), so that one table of weights
serves every text. A word's mark counts by the evidence that its documents are graded unlike the others, so that rare words with
clear evidence are heard and the many without it do not drown them. The result is the expected grade and the
probability of the tail, P(y >= grade), by which documents are selected.

Fitting takes a bounded sample: the `max_train` rated documents whose ids hash lowest. Their features are made on the
executors and one task fits them, as the sample is bounded; the weights (2**BITS at most) are all that reaches the driver.
Scoring is a pass over all documents without a shuffle.

Cases: a null or empty text, or one without words, has expected grade 0 and tail probability 0, and is not selected; ratings
that are null, or without a document, are left out; documents rated twice teach twice; without ratings every document with words
is selected at tail probability 1; repeated rows keep one row each; extra columns are passed on only by `select_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Block, U, blocks, repeated, span_hash

BITS = 18
#: The first slots belong to the shares of the layout.
_SHARES = 6
MAX_TRAIN = 8192
#: A hashed word needs this many documents of the sample, whatever its size, to get a weight.
_LEAST_DOCS = 4
#: Bytes of the beginnings that are marked of longer words.
_BEGINNINGS = (5, 7)
#: The likelihood ratio statistic from which a word's mark counts in full (about one in 20000 by chance with three grades).
_FULL_EVIDENCE = 20.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[97:123] = np.arange(48, 58), np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SYMBOL, _CAPITAL, _LETTER, _BAR, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&<>!=@~^_")] = True
_CAPITAL[65:91] = True
_LETTER[65:91], _LETTER[97:123] = True, True
_BAR[124], _DIGIT[48:58] = True, True


class _Folded(Block):
    """Words of letters and digits, in lower case."""

    def __init__(self, b: Block) -> None:
        column = pa.LargeStringArray.from_buffers(b.n, pa.py_buffer(b.off.astype(np.int64).tobytes()), pa.py_buffer(_FOLD[b.data].tobytes()))
        super().__init__(pa.RecordBatch.from_arrays([column], ["text"]), "text")


def features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, slot and value of what is not zero; slots of words occur once per document."""
    f = _Folded(b)
    slot = (f.hash >> np.uint64(64 - BITS)).astype(np.int64)
    owners, marks = [f.doc], [slot]
    for k in _BEGINNINGS:
        longer = np.flatnonzero(f.end - f.start > k)
        begun = span_hash(f.data, f.start[longer], f.start[longer] + k) ^ U(k * 0x9E3779B97F4A7C15 % (1 << 64))
        owners.append(owners[0][longer])
        marks.append((begun >> U(64 - BITS)).astype(np.int64))
    pairs = np.unique(np.concatenate(owners) << BITS | np.maximum(np.concatenate(marks), _SHARES))
    words = np.maximum(f.count, 1)
    again = f.per_doc_words(repeated(f.hash ^ (f.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    same = np.zeros(len(f.hash), bool)
    same[1:] = (f.hash[1:] == f.hash[:-1]) & (f.doc[1:] == f.doc[:-1])
    letters = np.maximum(b.per_doc(_LETTER[b.data]), 1)
    shares = [b.per_doc(_SYMBOL[b.data]) / words, b.per_doc(_CAPITAL[b.data]) / letters, f.per_doc_words(same) / words, b.per_doc(_BAR[b.data]) / words, b.per_doc(_DIGIT[b.data]) / np.maximum(np.diff(b.off), 1), again / words]
    own = np.arange(b.n)
    doc = np.concatenate([pairs >> BITS, *[own] * _SHARES])
    place = np.concatenate([pairs & (1 << BITS) - 1, *(np.full(b.n, i) for i in range(_SHARES))])
    value = np.concatenate([np.ones(len(pairs)), *(4 * np.minimum(s, 1) for s in shares)])
    return doc, place, value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1..K-1, by document."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _strength(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, slots: int) -> np.ndarray:
    """From 0 to 1 by slot: how clearly the grades of its documents differ from all grades."""
    seen, ratio = np.bincount(slot, minlength=slots), np.zeros(slots)
    for y in range(int(grade.max()) + 1):
        own = np.bincount(slot[grade[doc] == y], minlength=slots)
        expected = seen * (grade == y).mean()
        some = own > 0
        ratio[some] += 2 * own[some] * np.log(own[some] / expected[some])
    return np.clip(ratio / _FULL_EVIDENCE, 0, 1) ** 2


def fit_arrays(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, rounds: int = 300, rate: float = 0.3, l2: float = 5e-4) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam; grades are 0..K-1. The shares of the layout are not penalised."""
    n, k = len(grade), max(int(grade.max()) + 1, 2)
    seen = np.bincount(slot)
    used = np.flatnonzero(seen)
    layout = used < _SHARES
    common = (seen[used] >= _LEAST_DOCS) | layout
    keep = np.zeros(len(seen), bool)
    keep[used[common]] = True
    keep = keep[slot]
    number = np.zeros(len(seen), np.int32)
    number[used] = np.arange(len(used))
    doc, slot, value = doc[keep].astype(np.int32), number[slot[keep]], value[keep].astype(np.float32)
    strength = np.where(layout, 1.0, _strength(doc, slot, grade, len(used)))
    value = (value * strength[slot]).astype(np.float32)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k))[:-1] / n, 0.01, 0.99)
    theta = np.log(share / (1 - share))
    # all parameters in one vector: weights, the first threshold, and the logarithms of the steps to the next ones
    x = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v = np.zeros(len(x)), np.zeros(len(x))
    bounds = lambda t: np.concatenate([[-np.inf], t, [np.inf]])
    for i in range(1, rounds + 1):
        w, t = x[: len(used)], x[len(used) :]
        theta = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        score = np.bincount(doc, value * w[slot], minlength=n)
        upper, lower = _sigmoid(bounds(theta)[grade + 1] - score), _sigmoid(bounds(theta)[grade] - score)
        likely = np.maximum(upper - lower, 1e-9)
        gw = np.bincount(slot, value * ((upper + lower - 1) / n)[doc], minlength=len(used)) - l2 * np.where(layout, 0, w)
        d = np.zeros(k + 1)
        np.add.at(d, grade + 1, upper * (1 - upper) / likely / n)
        np.add.at(d, grade, -lower * (1 - lower) / likely / n)
        tail = np.cumsum(d[1:k][::-1])[::-1]
        g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(t[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    t = x[len(used) :]
    weights = np.zeros(1 << BITS)
    weights[used[common]] = (x[: len(used)] * strength)[common]
    return OrdinalModel(weights, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))]))


def _features_of_rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text"):
            doc, slot, value = features(b)
            order = np.argsort(doc, kind="stable")
            offsets = pa.array(np.searchsorted(doc[order], np.arange(b.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.ListArray.from_arrays(offsets, pa.array(slot[order].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value[order].astype(np.float32)))], ["grade", "slots", "vals"])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grades, sizes, slots, values = [], [], [], []
    for b in batches:  # as small numbers, batch by batch, so that the sample is held once
        grades.append(b.column(0).to_numpy())
        sizes.append(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
        slots.append(b.column(1).flatten().to_numpy().copy())
        values.append(b.column(2).flatten().to_numpy().copy())
    grade = np.concatenate(grades) if grades else np.zeros(0)
    if not len(grade):
        return
    slot, value = np.concatenate(slots), np.concatenate(values)
    del slots, values
    doc = np.repeat(np.arange(len(grade), dtype=np.int32), np.concatenate(sizes))
    model = fit_arrays(doc, slot, value, grade.astype(np.int64))
    at = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array([model.thresholds.tolist()], pa.list_(pa.float64())), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([model.weights[at].tolist()], pa.list_(pa.float64()))], ["thresholds", "slots", "weights"])


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """The model from at most max_train rated documents; grade is an expression over ratings, with values 0..K-1."""
    sample = ratings.select(F.col(id_col).cast("long").alias("rated"), grade.cast("int").alias("grade")).where("rated IS NOT NULL AND grade IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("rated"), "rated", "grade").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("rated"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "rated").where("text IS NOT NULL")
    seen = rows.select("grade", "text").mapInArrow(_features_of_rated, "grade int, slots array<int>, vals array<float>")
    got = seen.repartition(1).sortWithinPartitions("grade", F.xxhash64("slots")).mapInArrow(_fit_task, "thresholds array<double>, slots array<int>, weights array<double>").collect()
    if not got:
        return None
    weights = np.zeros(1 << BITS)
    weights[np.array(got[0].slots, np.int64)] = got[0].weights
    return OrdinalModel(weights, np.array(got[0].thresholds))


def _scores(b: Block, model: OrdinalModel | None, tail: int) -> tuple[np.ndarray, np.ndarray]:
    some = b.count > 0
    if model is None:
        return np.zeros(b.n), some.astype(float)
    doc, slot, value = features(b)
    tails = model.tails(np.bincount(doc, value * model.weights[slot], minlength=b.n))
    at = tails[:, tail - 1] if tail <= tails.shape[1] else np.zeros(b.n)
    return np.where(some, tails.sum(1), 0.0), np.where(some, at, 0.0)


def score_documents(docs: DataFrame, model: OrdinalModel | None, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of `tail` or more)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                expected, at = _scores(b, model, tail)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected), pa.array(at)], ["doc_id", "expected_grade", "tail_probability"])

    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def select_documents(docs: DataFrame, model: OrdinalModel | None, tail: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose tail probability is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, text_col):
                _, at = _scores(b, model, tail)
                yield b.batch.filter(pa.array(at >= least))

    return docs.mapInArrow(run, docs.schema)
