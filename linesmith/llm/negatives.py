"""Hard negatives by lists that the anchors of a cluster share.

Anchors are dealt to clusters of like direction. For a cluster, a shard's candidates are sorted once by an upper bound of their
inner product with any member: |x| cos(max(0, angle(x, centre) - radius)), the radius being the largest angle of a member to the
centre. Every member walks that list from its head and stops where |anchor| times the bound cannot reach what it still needs: then
nothing further can belong to its answer. The first walk finds the positives of an anchor, the second the negatives of each
positive; the answers of all shards are merged by score and id.

Candidates with the same label and vector form a class that keeps as many smallest ids as an answer can hold. Classes are dealt to
shards of SHARD_SIZE, which grow with the table beyond MOST_SHARDS of them; every anchor meets every shard. A shard comes to a task
before the anchors that stream past it, cluster by cluster.

Cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; rows that repeat an id
count once, with the smallest label and vector; vectors meet only those of the same dimension, also the empty ones, whose products
are 0; ties go to the smaller id; scores outside of 64 bits are held at their limits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Classes of a shard while there are few, shards while there are many, and classes of a shard at most.
SHARD_SIZE = 8192
MOST_SHARDS = 1024
LARGEST_SHARD = 1 << 18
#: Clusters of anchors, and anchors that they are fitted on at most (those of the smallest hash).
CLUSTERS = 32
SAMPLE = 4096
#: Anchors that share one sorted list in a task, anchors that one copy of a shard answers, places of the list read in one step.
GROUP = 1024
ANCHOR_BLOCK = 1 << 16
STEP = 512
MOST_TASKS = 20_000
_ANGLE_SLACK = 1e-6
_EXACT = float(2**53)


def whole(x: Column) -> Column:
    """The floor of a double as a double, also beyond 64 bits, where a double is whole anyway."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def candidates(table: DataFrame, id_col: str, label: Column, vec_col: str, scale: int = 256) -> DataFrame:
    """id, label, v (whole numbers in doubles) of the rows that take part, one per id."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vec_col, lambda x: x.cast("double") * scale).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return rows.withColumn("v", F.transform("v", whole)).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles while every sum fits them, else by whole numbers of any size."""
    largest = (np.abs(a).max(initial=0.0) or 0.0) * (np.abs(x).max(initial=0.0) or 0.0) * max(a.shape[1], 1)
    if largest < _EXACT:
        return (a @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    exact = big(a).dot(big(x).T) if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def fit_clusters(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means over rows of unit vectors."""
    if not len(sample):
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, max(1, min(clusters, len(sample) // 4))).astype(int)]
    for _ in range(rounds):
        of = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    top = np.where(top > 0, top, 1)
    norm = np.sqrt(((x / top) ** 2).sum(1)) * top[:, 0]
    return x / np.where(norm > 0, norm, 1)[:, None], norm


class _Best:
    """The first k (score descending, id ascending) of each of n answers."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.of, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The score that a further row must reach to enter; the lowest number while an answer is not full.
        self.need = np.full(n, np.iinfo(np.int64).min)

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        of, score, id_ = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, ~score, of))
        of, score, id_ = of[order], score[order], id_[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        keep = place < self.k
        self.of, self.score, self.id = of[keep], score[keep], id_[keep]
        last = place[keep] == self.k - 1
        self.need[self.of[last]] = self.score[last]


class Shard:
    """Candidates of one shard: classes of a label and a vector, with their smallest ids."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: list[list[int]]) -> None:
        self.x, self.label = x, label
        self.unit, self.norm = _unit(x)
        self.count = np.array([len(i) for i in ids], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.ids = np.array([i for some in ids for i in some], np.int64)
        #: Places of lists that were read, for reports and tests.
        self.read = 0

    def order(self, a_unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list that the anchors share: candidates by descending bound, and that bound for an anchor of length 1."""
        centre = a_unit.sum(0, keepdims=True)
        centre, _ = _unit(centre)
        angle = lambda u: np.arccos(np.clip(u @ centre[0], -1, 1))
        radius = angle(a_unit).max(initial=0.0)
        bound = self.norm * np.cos(np.maximum(0, angle(self.unit) - radius - _ANGLE_SLACK))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def walk(self, a: np.ndarray, a_norm: np.ndarray, own: np.ndarray, order: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> _Best:
        """The first k candidates of each answer whose scores lie in [low, high]; answers are cells of low (anchors x windows)."""
        n, windows = low.shape
        best = _Best(n * windows, k)
        cell = np.arange(n * windows).reshape(n, windows)
        live = np.flatnonzero((low <= high).any(1))
        for at in range(0, len(order), STEP):
            reach = a_norm[live] * bound[at]
            reach += np.abs(reach) * 1e-9 + 1e-6
            need = np.where(low[live] <= high[live], np.maximum(low[live], best.need[cell[live]]), np.iinfo(np.int64).max)
            live = live[(reach[:, None] >= need).any(1)]
            if not len(live):
                break
            part = order[at : at + STEP]
            self.read += len(live) * len(part)
            score = products(a[live], self.x[part])
            for w in range(windows):
                least = np.maximum(low[live, w], best.need[cell[live, w]])
                r, c = np.nonzero((score >= least[:, None]) & (score <= high[live, w][:, None]))
                if not len(r):
                    continue
                many = self.count[part[c]]
                at_id = np.repeat(self.first[part[c]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                id_, r_, s_ = self.ids[at_id], np.repeat(live[r], many), np.repeat(score[r, c], many)
                other = id_ != own[r_]
                best.add(cell[r_[other], w], s_[other], id_[other])
        return best


def _walks(positives: bool, k: int):
    """Over rows sorted by (dim, shard, block, kind, cluster, label): a shard's classes, then the anchors that walk its lists."""

    def answer(shard: Shard, rows: list[tuple]) -> list[tuple]:
        ids = np.array([r[0] for r in rows], np.int64)
        label = np.array([r[1] for r in rows], np.int64)
        a = np.array([r[2] for r in rows], np.float64).reshape(len(rows), shard.x.shape[1])
        a_unit, a_norm = _unit(a)
        order, bound = shard.order(a_unit)
        out: list[tuple] = []
        for its in np.unique(label):
            of = np.flatnonzero(label == its)
            fits = (shard.label[order] == its) == positives
            if positives:
                low, high = np.full((len(of), 1), np.iinfo(np.int64).min), np.full((len(of), 1), np.iinfo(np.int64).max)
            else:
                low, high = (np.array([r[i] for r in (rows[j] for j in of)], object) for i in (3, 4))
                wide = max(len(x) for x in low)
                pad = lambda many, fill: np.array([list(x) + [fill] * (wide - len(x)) for x in many], np.int64).reshape(len(of), wide)
                low, high = pad(low, 1), pad(high, 0)
            best = shard.walk(a[of], a_norm[of], ids[of], order[fits], bound[fits], low, high, k)
            out += zip(ids[of][best.of // low.shape[1]].tolist(), (best.of % low.shape[1]).tolist(), best.id.tolist(), best.score.tolist(), strict=True)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard, waiting, cluster = None, [], None, [], None

        def flush() -> list[tuple]:
            nonlocal waiting
            out = answer(shard, waiting) if waiting else []
            waiting = []
            return out

        def said(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "window", "id", "score"])

        for batch in batches:
            rows = batch.to_pylist()
            out: list[tuple] = []
            for r in rows:
                now = (r["dim"], r["shard"], r["block"])
                if now != key:
                    out += flush()
                    key, held, shard, cluster = now, [], None, None
                if r["kind"] == 0:
                    held.append((r["v"], r["label"], r["ids"]))
                    continue
                if shard is None:
                    shard = Shard(np.array([h[0] for h in held], np.float64).reshape(len(held), key[0]), np.array([h[1] for h in held], np.int64), [h[2] for h in held])
                    held = []
                if r["cluster"] != cluster or len(waiting) >= GROUP:
                    out += flush()
                    cluster = r["cluster"]
                waiting.append((r["id"], r["label"], r["v"], r["low"], r["high"]))
            if out:
                yield said(out)
        if out := flush():
            yield said(out)

    return run


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """dim, shard, label, v and the smallest ids of every class of rows; hot classes are cut to their smallest ids in 32 parts first."""
    place = F.row_number().over(Window.partitionBy("label", "v", "salt").orderBy("id"))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", place).where(F.col("r") <= keep)
    classes = stored(few.groupBy("label", "v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")).withColumn("dim", F.size("v")))
    n = F.count(F.lit(1))
    size = F.least(F.greatest(F.lit(SHARD_SIZE), F.ceil(n / MOST_SHARDS)), F.lit(LARGEST_SHARD))
    sizes = classes.groupBy("dim").agg(F.ceil(n / size).cast("int").alias("shards"))
    return classes.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("label", "v"), F.col("shards")).cast("int"))


def _clustered(anchors: DataFrame, clusters: int) -> DataFrame:
    """anchors with their cluster; the centres come from a bounded sample of the dimension that most of it has."""
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    dims = pd.Series([len(r.v) for r in sample])
    dim = int(dims.mode()[0]) if len(dims) else 0
    sample = [r.v for r in sample if len(r.v) == dim]
    centres = fit_clusters(_unit(np.array(sample, np.float64).reshape(len(sample), dim))[0], clusters)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cluster"] = 0
            same = np.flatnonzero(pdf["dim"] == dim)
            if len(same) and len(centres):
                x = np.array(pdf["v"].iloc[same].tolist(), np.float64).reshape(len(same), dim)
                pdf.iloc[same, pdf.columns.get_loc("cluster")] = (_unit(x)[0] @ centres.T).argmax(1)
            yield pdf

    rows = anchors.select("id", "label", "v", F.size("v").alias("dim"))
    return rows.mapInPandas(assign, "id long, label long, v array<double>, dim int, cluster int")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, clusters: int = CLUSTERS) -> DataFrame:
    """The first negatives of every positive of every anchor: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows come from candidates(); a negative has another label and a score of low to high percent of the positive's.
    """
    rows = stored(rows)
    classes = stored(_classes(rows, max(positives, negatives) + 1))
    anchors = stored(_clustered(rows.where(is_anchor), clusters))
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    shards = classes.select("dim", "shard").distinct()
    total = shards.count() or 1
    held = classes.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(0), "cluster": F.lit(0)})

    def walked(asked: DataFrame, first: bool, k: int) -> DataFrame:
        asked = asked.join(F.broadcast(shards), "dim").withColumns({"block": F.pmod(F.xxhash64("dim", "cluster", "id"), F.lit(blocks)).cast("int"), "kind": F.lit(1)})
        both = held.unionByName(asked, allowMissingColumns=True).repartition(min(4 * total * blocks, MOST_TASKS), "dim", "shard", "block")
        both = both.select("dim", "shard", "block", "kind", "cluster", "label", "id", "v", "ids", "low", "high").sortWithinPartitions("dim", "shard", "block", "kind", "cluster", "label")
        return both.mapInArrow(_walks(first, k), "anchor_id long, window int, id long, score long")

    def firsts(found: DataFrame, *by: str, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)

    nothing = F.lit(None).cast("array<bigint>")
    near = walked(anchors.withColumns({"low": nothing, "high": nothing}), True, positives)
    near = stored(firsts(near, "anchor_id", k=positives).select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Scores of up to 64 bits times 100 pass them, so limits are taken in decimals: the least and the largest whole score inside.
    limits = near.withColumns({"l": F.expr(f"CAST(ceil(CAST(positive_score AS DECIMAL(30,0)) * {low} / 100) AS BIGINT)"), "h": F.expr(f"CAST(floor(CAST(positive_score AS DECIMAL(30,0)) * {high} / 100) AS BIGINT)")})
    windows = limits.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "l", "h"))).alias("w")).select(F.col("anchor_id").alias("id"), F.col("w.l").alias("low"), F.col("w.h").alias("high"))
    far = firsts(walked(anchors.join(windows, "id"), False, negatives), "anchor_id", "window", k=negatives)
    far = far.select("anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
