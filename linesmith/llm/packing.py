"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest capacity are cut into pieces of it; all pieces go to shards by hash, so that a shard holds
about `shard_tokens` tokens whatever the corpus, and each shard is packed by itself. Pieces come by decreasing length. Each goes to
the open bin that it leaves fullest; if none has room, a bin is opened at the capacity that costs least per token with what is
still to come: for each capacity, the pieces still to come are put beside the piece in their order, as far as they fit, and the
bin is priced at the least capacity that holds the outcome. So all capacities compete for every bin, given the lengths that are
left. At the end every bin is cut down to the least capacity that holds its contents, which pads least and costs least.

Cases: documents without tokens take no room and are returned with null bin, offset and capacity; repeated rows are packed as
often as they occur; ties in length go by id, piece and hash, ties between bins to the older one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

CAPACITIES = (256, 512, 1024, 2048)
SHARD_TOKENS = 2_000_000


def cost(capacity: int) -> float:
    """Of one sequence: linear layers, attention and a fixed overhead, in tokens."""
    return capacity * (1 + capacity / 16384) + 16


class Opening:
    """Which capacity to open a bin at, over pieces by decreasing length."""

    def __init__(self, lengths: list[int], capacities: tuple[int, ...]) -> None:
        self.capacities, self.sums = capacities, [0, *accumulate(lengths)]
        ascending = lengths[::-1]
        #: The first piece that is no longer than v, for every v.
        self.fits = [len(lengths) - bisect_right(ascending, v) for v in range(capacities[-1] + 1)]

    def filled(self, i: int, capacity: int) -> int:
        """Tokens in a bin that holds piece i and those after it, in order, that still fit."""
        used, j, end = self.sums[i + 1] - self.sums[i], i + 1, len(self.sums) - 1
        while (j := max(j, self.fits[capacity - used])) < end:
            k = bisect_right(self.sums, self.sums[j] + capacity - used, j) - 1  # pieces j to k - 1 fit one after the other
            used, j = used + self.sums[k] - self.sums[j], k
        return used

    def size(self, i: int) -> int:
        """The capacity for a bin that begins with piece i; of equally good ones the smallest."""
        def price(c: int) -> float:
            used = self.filled(i, c)
            return cost(next(d for d in self.capacities if d >= used)) / used

        need = self.sums[i + 1] - self.sums[i]
        return min((c for c in self.capacities if c >= need), key=lambda c: (price(c), c))


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (lengths decrease), and the final capacity of each bin."""
    opening = Opening(lengths, capacities)
    room: list[tuple[int, int]] = []  # of open bins: what is free, and the number
    used: list[int] = []
    bins, offsets = [], []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = opening.size(i), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def _pack_shards(capacities: tuple[int, ...]):
    """Over rows sorted by shard and decreasing length."""

    def shard(key: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        bins, offsets, sizes = pack(t.column("length").to_pylist(), capacities)
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "piece", "n_tokens", "length")), pa.array([f"{key}-{b}" for b in bins]), pa.array(offsets, pa.int64()), pa.array([sizes[b] for b in bins], pa.int64())], ["doc_id", "piece", "n_tokens", "length", "bin", "offset", "capacity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            s = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if key is not None and s[a] != key:
                    yield from shard(key, parts)
                    parts = []
                key = int(s[a])
                parts.append(batch.slice(a, z - a))
        if parts:
            yield from shard(key, parts)

    return run


def pack_documents(docs: DataFrame, n_tokens: Column, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", spread: Column | None = None) -> DataFrame:
    """doc_id, piece (from 0), n_tokens of the document, length of the piece, bin, offset in it and capacity of the bin.

    n_tokens is an expression over docs, of which null counts as 0; spread is a further one by which rows of equal id and
    length are dealt to shards (the text, say).
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"), F.xxhash64(*([F.col(id_col)] + ([spread] if spread is not None else []))).alias("spread"))
    rows = stored(rows)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    pieces = rows.where("n_tokens > 0").select("doc_id", "n_tokens", "spread", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / top).cast("long"))).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(top), F.col("n_tokens") - F.col("piece") * top)).withColumn("shard", F.pmod(F.xxhash64("spread", "piece"), F.lit(shards)))
    order = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "spread").select("shard", "doc_id", "piece", "n_tokens", "length")
    packed = order.mapInArrow(_pack_shards(capacities), "doc_id long, piece long, n_tokens long, length long, bin string, offset long, capacity long")
    empty = rows.where("n_tokens = 0").selectExpr("doc_id", "0L AS piece", "n_tokens", "0L AS length", "CAST(NULL AS STRING) AS bin", "CAST(NULL AS LONG) AS offset", "CAST(NULL AS LONG) AS capacity")
    return packed.unionByName(empty)
