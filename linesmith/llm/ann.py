"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors form a class (with the k + 1 smallest ids, which are all that a top-k list can hold of it); classes are dealt to
shards by a hash. Every query meets every shard, so shards grow with the table: there are at most MOST_SHARDS until one of them
would hold more than LARGEST_SHARD vectors, and the work and bytes of a query stay bounded. In a shard every vector gets
out-edges: a greedy beam search over the graph so far proposes neighbours, and pruning keeps the nearest one and drops what
lies much nearer to it than to the vector, by a factor alpha; reverse edges are added and pruned alike. A shard's graph is
some rows of the index, which come to one task before the queries that stream past it; only QUERY_BLOCK queries ask for
another copy. Each runs a beam search, and the best of all shards are ranked by the exact cosine.

Cases: vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do rows with a null id; rows
that repeat an id count once (with the smallest vector); vectors meet only those of the same dimension; ties go to the smaller
id; with fewer candidates than k, all that were found are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Vectors of a shard while there are few, shards while there are many, and vectors of a shard at most.
SHARD_SIZE = 4096
MOST_SHARDS = 1024
LARGEST_SHARD = 1 << 18
#: Vectors in one row of the index.
CHUNK = 256
#: Queries that one copy of a shard's graph answers.
QUERY_BLOCK = 1 << 16
#: Tasks that build or search the graphs of shards, at most.
MOST_TASKS = 20_000
DEGREE = 24
BEAM = 48
SEARCH_BEAM = 128
ALPHA = 1.2
_SLACK = 16
_EXPAND = 4


class Graph:
    """Out-edges over unit vectors; -1 fills up a row."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE) -> None:
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        n = len(x)
        self.start = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        self.edges = np.full((n, degree + _SLACK), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for rows of q: nodes and similarities, best first; -1 where fewer were found."""
        m, n = len(q), len(self.x)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n + 1), bool)  # the last column stands for -1
        seen[:, [self.start, n]] = True
        ids = np.full((m, beam), -1, np.int32)
        sim = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], sim[:, 0], done[:, 0] = self.start, q @ self.x[self.start], False
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live], -np.inf, sim[live])
            step = min(_EXPAND, beam)
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step]
            fine = np.take_along_axis(open_, pick, 1) > -np.inf
            done[live[:, None], pick] = True
            source = np.where(fine, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(source[:, :, None] >= 0, self.edges[source], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            got = np.einsum("mkd,md->mk", self.x[near], q[live])
            got[near < 0] = -np.inf
            all_ids, all_sim = np.concatenate([ids[live], near], 1), np.concatenate([sim[live], got], 1)
            all_done = np.concatenate([done[live], near < 0], 1)
            best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids[live], sim[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sim, all_done))
            live = live[(~done[live]).any(1)]
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim = ids[rows, order], sim[rows, order]
        return np.where(sim > -np.inf, ids, -1), sim

    def prune(self, nodes: np.ndarray, found: np.ndarray, alpha: float) -> np.ndarray:
        """At most `degree` diverse neighbours of each node out of its candidates (-1 fills up)."""
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == nodes[:, None]] = -1
        far = 2 - 2 * np.einsum("mkd,md->mk", self.x[found], self.x[nodes])
        far[found < 0] = np.inf
        order = np.argsort(far, axis=1)
        found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
        v = self.x[found]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = far < np.inf
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            some = alive.any(1)
            if not some.any():
                break
            p = alive.argmax(1)
            out[some, k] = found[rows, p][some]
            alive &= alpha * alpha * between[rows, p] > far
            alive[rows, p] = False
        return out

    def link(self, nodes: np.ndarray, chosen: np.ndarray, alpha: float) -> None:
        """Sets the out-edges of nodes, and adds the reverse edges, pruning where a row is full."""
        width = self.edges.shape[1]
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = chosen
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hubs, first, count = np.unique(target, return_index=True, return_counts=True)
        old = self.edges[hubs]
        free = (old < 0).sum(1)
        have = width - free
        easy = count <= free
        at = np.arange(len(target)) - np.repeat(first, count)
        put = np.repeat(easy, count)
        packed = np.sort(np.where(old < 0, np.iinfo(np.int32).max, old), axis=1)
        packed[packed == np.iinfo(np.int32).max] = -1
        self.edges[hubs] = packed
        self.edges[target[put], np.repeat(have, count)[put] + at[put]] = source[put]
        for lo in range(0, len(full := np.flatnonzero(~easy)), 256):
            part = full[lo : lo + 256]
            more = np.full((len(part), int(count[part].max())), -1, np.int32)
            for r, h in enumerate(part):
                more[r, : count[h]] = source[first[h] : first[h] + count[h]]
            self.edges[hubs[part]] = -1
            self.edges[hubs[part], : self.degree] = self.prune(hubs[part], np.concatenate([packed[part], more], 1), alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1, batch: int = 256) -> Graph:
    """The graph over unit vectors: random edges first, then two passes over all nodes, the second with the relaxed alpha."""
    g, n = Graph(x, degree=degree), len(x)
    rng = np.random.default_rng(seed)
    if n > 1:
        k = min(degree // 2, n - 1)
        g.edges[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
    for a in (1.0, alpha) if n > 2 else ():
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            nodes = order[lo : lo + batch]
            found, _ = g.search(g.x[nodes], min(beam, n))
            g.link(nodes, g.prune(nodes, np.concatenate([found, g.edges[nodes]], 1), a), a)
    return g


def usable(v: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & (norm > 0) & (norm < float("inf"))


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (doubles) of usable rows, one per id."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def build_index(rows: DataFrame, k: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Rows of shards: dim, shard, chunk (from 0), vectors (doubles), edges and the smallest ids of every class. rows: id, v."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    place = F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))
    classes = salted.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = stored(classes.withColumn("dim", F.size("v")))
    n = F.count(F.lit(1))
    size = F.least(F.greatest(F.lit(shard_size), F.ceil(n / MOST_SHARDS)), F.lit(LARGEST_SHARD))
    sizes = classes.groupBy("dim").agg(F.ceil(n / size).cast("int").alias("shards"))
    dealt = classes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        g = build(x / np.linalg.norm(x, axis=1, keepdims=True))
        ids = [i.tolist() for i in pdf["ids"]]
        cuts = range(0, len(x), CHUNK)
        part = lambda a: [a[i : i + CHUNK].tobytes() for i in cuts]
        return pd.DataFrame({"dim": key[0], "shard": key[1], "chunk": range(len(cuts)), "vectors": part(x), "edges": part(g.edges), "ids": [ids[i : i + CHUNK] for i in cuts]})

    total = sizes.agg(F.sum("shards")).first()[0] or 1
    # A stated number of partitions, which adaptive execution leaves alone: building is far more work than its bytes tell.
    dealt = dealt.select("dim", "shard", "v", "ids", F.element_at("ids", 1).alias("first")).repartition(min(4 * total, MOST_TASKS), "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(shard, "dim int, shard int, chunk int, vectors binary, edges binary, ids array<array<long>>"))


class _Shard:
    """A shard's graph, put together from its rows."""

    def __init__(self, dim: int, rows: list[tuple]) -> None:
        self.x = np.concatenate([np.frombuffer(v, np.float64) for v, _, _ in rows]).reshape(-1, dim)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        edges = np.concatenate([np.frombuffer(e, np.int32) for _, e, _ in rows]).reshape(len(self.x), -1)
        self.graph = Graph(self.x / self.norm[:, None], edges)
        self.ids = [i for _, _, ids in rows for i in ids]

    def nearest(self, own: list[int], q: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        q_norm = np.sqrt((q * q).sum(1))
        for lo in range(0, len(q), 64):
            found, _ = self.graph.search((q[lo : lo + 64] / q_norm[lo : lo + 64, None]).astype(np.float32), min(beam, len(self.x)))
            for r, near in enumerate(found[:, : 4 * k], lo):
                near = near[near >= 0]
                score = (self.x[near] @ q[r]) / (self.norm[near] * q_norm[r])
                best = sorted((-s, i) for s, c in zip(score.tolist(), near.tolist(), strict=True) for i in self.ids[c] if i != own[r])[:k]
                yield from ((own[r], i, -s) for s, i in best)


def _search_shards(k: int, beam: int):
    """Over rows sorted by (dim, shard, block), a shard's graph before the queries that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, shard = None, [], None
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            keys = list(zip(*(column(c).to_pylist() for c in ("dim", "shard", "block", "kind")), strict=True))
            out: list[tuple[int, int, float]] = []
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo][:3] != key:
                    key, rows, shard = keys[lo][:3], [], None
                if keys[lo][3] == 0:
                    rows += zip(*(column(c).slice(lo, hi - lo).to_pylist() for c in ("vectors", "edges", "ids")), strict=True)
                else:
                    if shard is None:
                        shard, rows = _Shard(key[0], rows), []
                    q = column("v").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
                    out += shard.nearest(column("id").slice(lo, hi - lo).to_pylist(), q, k, beam)
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query (id, v), its own row excluded."""
    queries = stored(queries)
    blocks = max(1, -(-queries.count() // query_block))
    shards = index.where("chunk = 0").select("dim", "shard")
    total = shards.count() or 1
    asked = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).join(shards, "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    both = held.unionByName(asked.withColumns({"kind": F.lit(1), "chunk": F.lit(0)}), allowMissingColumns=True)
    both = both.repartition(min(4 * total * blocks, MOST_TASKS), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind", "chunk")
    found = both.mapInArrow(_search_shards(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
