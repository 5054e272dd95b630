"""Removal of repeated passages by difference-cover anchors.

A passage of `window` words that occurs twice anywhere in the corpus is removed at every place. The positions of a document
are taken modulo a period whose difference cover holds, for any two residues, a shift under which both land in the cover.
So two equal windows, wherever they start, share an anchor of `window - period + 1` words that begins at a cover position in
both. The steps:

1. hash the anchors at cover positions only, count them over the corpus (partial sums before the shuffle), keep those that
   occur twice or more;
2. find the places of those anchors again (a semi join on the hash), and gather them by document;
3. extend: only windows around such places can be repeated; they are hashed with 128 bits and counted. The aggregation also
   keeps the least place, which for a count of one is the window's own: so it names the windows that are not repeated;
4. all other windows around the places are repeated; the words outside of them are kept.

Nothing is paired, and no window of a hot passage is shuffled more than once per task: both counts have partial sums, and the
semi join has one row per hash on its other side, so that a hot hash can be split. Documents are recognised by a 64-bit key of
id and text, so ids may be null or repeated; rows that repeat id and text count as different documents, as any two rows do.

Cases: a null or empty text has no words (0, 0 and the digest of the empty string); documents with fewer words than the window
lose nothing; repeated rows lose all words if they have at least a window of them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored
from .words import Block, covered, per_block, window_hash

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21: every residue is a difference of two of its members.
COVER = (0, 1, 4, 14, 16)


def _anchors(b: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and position in it of the anchors at cover positions."""
    k = window - PERIOD + 1
    at = b.windows(k)
    at = at[np.repeat(b.count, b.count)[at] >= window]
    doc = np.searchsorted(b.first, at, "right") - 1
    place = at - b.first[doc]
    chosen = np.isin(place % PERIOD, COVER)
    at, doc, place = at[chosen], doc[chosen], place[chosen]
    return window_hash(b.hash, at, k), doc, place


def _count_anchors(window: int):
    def run(b: Block) -> pa.RecordBatch:
        h, n = np.unique(_anchors(b, window)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    return run


def _place_anchors(window: int):
    def run(b: Block) -> pa.RecordBatch:
        h, doc, place = _anchors(b, window)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("k").take(pa.array(doc)), pa.array(place.astype(np.int32))], ["h", "k", "p"])

    return run


def _lists(b: Block, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of int lists, and the document of each."""
    column = b.column(name)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b.n), sizes)


def _around(b: Block, window: int) -> np.ndarray:
    """The windows that hold an anchor found twice."""
    place, doc = _lists(b, "ps")
    real = place < b.count[doc] - (window - PERIOD)
    place, doc = place[real], doc[real]
    low = np.maximum(place - (PERIOD - 1), 0) + b.first[doc]
    high = np.minimum(place, b.count[doc] - window) + b.first[doc]
    fine = high >= low
    step = np.zeros(len(b.start) + 1, np.int64)
    np.add.at(step, low[fine], 1)
    np.add.at(step, high[fine] + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _extend(window: int):
    def run(b: Block) -> pa.RecordBatch:
        at = _around(b, window)
        doc = np.searchsorted(b.first, at, "right") - 1
        h1, h2 = (window_hash(b.hash, at, window, w).view(np.int64) for w in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), b.column("k").take(pa.array(doc)), pa.array((at - b.first[doc]).astype(np.int32))], ["h1", "h2", "k", "p"])

    return run


def _cut(window: int):
    def run(b: Block) -> pa.RecordBatch:
        alone, doc = _lists(b, "alone")
        real = alone + window <= b.count[doc]
        at = np.setdiff1d(_around(b, window), alone[real] + b.first[doc[real]], assume_unique=True)
        gone = covered(at, window, len(b.start))
        removed = b.per_doc_words(gone)
        text, sha = [], []
        for i in range(b.n):
            words = b.words_of(i)
            if removed[i]:
                keep = ~gone[b.first[i] : b.first[i + 1]]
                words = [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]
            kept = b" ".join(words)
            sha.append(hashlib.sha256(kept).hexdigest())
            text.append(kept.decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(b.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, kept_sha256 of every row of docs."""
    if window < PERIOD + 4:
        raise ValueError(f"window must be at least {PERIOD + 4} words")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))

    twice = rows.select("text").mapInArrow(per_block(_count_anchors(window)), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    twice = stored(twice)
    places = rows.select("text", "k").mapInArrow(per_block(_place_anchors(window)), "h long, k long, p int")
    places = places.join(twice, "h", "left_semi").groupBy("k").agg(F.collect_set("p").alias("ps"))
    places = stored(places)

    # Both uses of the texts have the same columns and partitioning, so that Spark shuffles them once.
    windows = rows.join(places, "k").select("doc_id", "text", "k", "ps").mapInArrow(per_block(_extend(window)), "h1 long, h2 long, k long, p int")
    counts = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.min("p").alias("p"))
    alone = counts.where("n = 1").groupBy("k").agg(F.collect_list("p").alias("alone"))
    out = rows.join(places, "k", "left").join(alone, "k", "left").select("doc_id", "text", "ps", "alone")
    return out.mapInArrow(per_block(_cut(window)), "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
