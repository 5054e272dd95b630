"""Exact Jaccard join of the word-shingle sets of documents, with set-relation skipping.

Sets that are equal form a class, which is joined once. Tokens have one order: by hash, with those that hold a large share of the
corpus last (heavy ones, told by counters of a fixed number). A set is indexed by the first tokens of that order, its prefix,
of which similar sets must share one, and by all its light tokens of low hash, so that lists of the latter are complete.

* set level: a token whose complete list names one class alone is shared with no other set. A class with more such tokens than
  a similar set may differ in is done, without being compared to anything;
* index level: postings carry the position of the token in its set. What the first tokens of sets join already (by bitmaps, see
  below) is one group. A list is sorted by size and cut into blocks of consecutive sets of one group; a block is skipped
  unless a set of another group is in reach of its sizes and positions (`_skip`);
* bitmaps of the parities of hashed tokens bound the difference of two sets from below. The sets that are left in a list are
  gathered around leaders, at distances at which no similar pair is torn apart, so only plausible groups remain. They are
  verified one by one; a large one is dealt out as pairs of blocks of bounded size, so that no task holds a whole group and
  no pair is a row;
* answer level: within a task a set takes over the overlaps that were computed for a highly similar set before it, and only
  the lists of the tokens in which the two differ are read.

Each task returns, per class, the number of documents linked to it and its root among the classes of the task.

Cases: rows with a null id are returned with their set size and no component, and link with nothing; null, empty and blank
texts have empty sets and link with nothing; a text of fewer words than a shingle is one shingle; rows with equal texts are
linked, also under one id; several texts under one id are sets of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, prepare
from .words import Block, blocks, mix, per_block, window_hash

U = np.uint64
#: Counters that tell heavy tokens; their number is fixed, whatever the corpus.
SKETCH_BITS = 22
#: A token is heavy if its counter holds more than this share of all counted tokens, so there are at most as many heavy ones.
HEAVY = 2.0**-19
#: Fewer than this are never heavy.
LEAST_HEAVY = 64
#: Bits of a token that come from its hash; its level stands above them.
TOKEN_BITS = 58
#: Classes that a task remembers, so as not to send equal sets again.
_REMEMBERED = 1 << 16
#: Rows of one batch of postings.
_ROWS_OUT = 16_384
#: Tokens of each class whose lists make the first groups.
_FIRST = 2
#: Entries of one group that are held back until the next block of their list is seen; more are kept without being looked at.
_HELD = 1 << 20
#: The largest bitmap of a set; beyond its size sets are only told apart less well before they are verified.
_MOST_BITS = 1 << 16
#: Sets, and tokens, in one block of a group under verification.
BLOCK_SETS = 512
BLOCK_TOKENS = 400_000
#: The largest list of classes (60 bytes a row) that is broadcast to find their texts.
BROADCAST_ROWS = 1_000_000


def shingles(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents of a block, by document and hash, and where each document's begin."""
    at = b.windows(k)
    doc = np.searchsorted(b.first, at, "right") - 1
    h = window_hash(b.hash, at, k)
    short = np.flatnonzero((b.count > 0) & (b.count < k))
    if len(short):
        own = [window_hash(b.hash[b.first[i] : b.first[i + 1]], np.zeros(1, np.int64), int(b.count[i]))[0] for i in short]
        h, doc = np.concatenate([h, np.array(own, U)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(b.n + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with a similar set, at least."""
    return -(-percent * n // 100)


def low_share(percent: int) -> float:
    """The share of tokens, by hash, whose lists are complete: somewhat more than a prefix."""
    return min(1.0, 1.1 - percent / 100)


def _counters(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U(64 - SKETCH_BITS)).astype(np.int64)


def _count_low(k: int, share: float):
    """Counters of the tokens of low hash: those that a heavy token may have, by task, and the tokens counted (counter -1)."""
    most = U(min(int(share * 2.0**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, all_ = np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for batch in batches:
            for b in blocks(batch, "text", lower=True):
                h, _ = shingles(b, k)
                at, n = np.unique(_counters(h[h <= most]), return_counts=True)
                total[at] += n.astype(np.uint32)
                all_ += int(n.sum())
        at = np.flatnonzero(total > max(1, all_ * HEAVY / 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], all_).astype(np.int64))], ["counter", "n"])

    return run


def heavy_levels(docs: DataFrame, k: int, share: float) -> np.ndarray:
    """By counter: 0 for light tokens, and 1 up to 60 for heavy ones by how often they occur.

    The driver gets at most 1 / HEAVY rows. The levels only set an order of tokens, so the result does not depend on them.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.stored(docs.mapInArrow(_count_low(k, share), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")))
    total = counted.where("counter < 0").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("counter") >= 0) & (F.col("n") > max(LEAST_HEAVY, total * HEAVY))).toArrow()
    scratch.drop(counted)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[rows["counter"].to_numpy()] = np.minimum(np.log2(rows["n"].to_numpy()), 60).astype(np.uint8)
    return out


def ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens as numbers in their order: light ones by the leading bits of their hash, then heavy ones."""
    return level[_counters(h)].astype(U) << U(TOKEN_BITS) | h >> U(64 - TOKEN_BITS)


def _marks(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits each that tell the sets of a block apart."""
    n = np.diff(first)
    total = np.zeros((2, len(h) + 1), U)
    np.cumsum(mix(h), out=total[0, 1:])
    np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), out=total[1, 1:])
    return np.stack([mix(total[i, first[1:]] - total[i, first[:-1]] + n.astype(U)) for i in (0, 1)]).view(np.int64)


def _index_prefix(h: np.ndarray, first: np.ndarray, percent: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block's documents in their order, and by document: light tokens of low hash, tokens to index, positions of all tokens."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    token = ordered(h, level)
    token = token[np.lexsort((token, doc))]
    low = np.zeros(len(h) + 1, np.int64)
    np.cumsum(token < U(int(low_share(percent) * 2.0**TOKEN_BITS)), out=low[1:])
    low = low[first[1:]] - low[first[:-1]]
    most = np.maximum(low, np.where(n > 0, n - needed(n, percent) + 1, 0))
    return token, low, most, np.arange(len(h)) - np.repeat(first[:-1], n)


def _sets(k: int, percent: int, levels):
    """Of each document: the size of its set, its mark, light tokens of low hash, and a bitmap."""

    def run(b: Block) -> pa.RecordBatch:
        h, first = shingles(b, k)
        n = np.diff(first)
        mark = _marks(h, first)
        low = _index_prefix(h, first, percent, levels.value)[1]
        maps = [_bitmap(h[first[i] : first[i + 1]], 2 if percent >= 90 else 2.6) if n[i] else None for i in range(b.n)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(mark[0]), pa.array(mark[1]), pa.array(low), pa.array(maps, pa.binary())], ["doc_id", "n", "m", "m2", "low", "bitmap"])

    return per_block(run, lower=True)


def _postings(k: int, percent: int, levels):
    """(token, class, position) of the tokens to index; a task sends equal sets once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch, "text", lower=True):
                h, first = shingles(b, k)
                mark = _marks(h, first)[0]
                token, _, most, place = _index_prefix(h, first, percent, levels.value)
                new = np.zeros(b.n, bool)
                for i, m in enumerate(mark.tolist()):
                    new[i] = m not in seen
                    seen.add(m)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                doc = np.repeat(np.arange(b.n), np.diff(first))
                keep = (place < most[doc]) & new[doc]
                out = pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(mark[doc[keep]]), pa.array(place[keep].astype(np.int32))], ["token", "m", "place"])
                for at in range(0, out.num_rows, _ROWS_OUT):
                    yield out.slice(at, _ROWS_OUT)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over postings sorted by token and class: those of tokens that two classes hold, each once."""
    held, before = np.zeros((3, 0), np.int64), False
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])], 1)
        if not rows.shape[1]:
            continue
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, new]
        same = rows[0, 1:] == rows[0, :-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[before], same])
        yield _as_batch(rows[:, :-1][:, keep[:-1]], ["token", "m", "place"])
        held, before = rows[:, -1:], bool(same[-1]) if len(same) else before
    if held.shape[1] and before:
        yield _as_batch(held, ["token", "m", "place"])


def _as_batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names)


def _bitmap(h: np.ndarray, per_token: float) -> bytes:
    """Parities of the numbers of tokens by their lowest bits; the size is a power of two, `per_token` bits a token at least."""
    bits = min(max(128, 1 << int(np.ceil(per_token * len(h)) - 1).bit_length()), _MOST_BITS)
    return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller size (both in 64-bit words)."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size), axis=0)


def largest_partner(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that can be similar to one of n whose first token in common stands at `place`.

    With m >= n, similar sets share percent * (n + m) / (100 + percent) tokens, and no more than n - place are left.
    """
    return np.minimum(100 * n // percent, ((100 + percent) * (n - place) - percent * n) // percent)


def _bands(rows: np.ndarray, percent: int) -> pa.RecordBatch:
    """Runs of a list, of sizes that may be similar: a band holds the sizes from 2**k up to 2**(k + 1), and below it those that may still be similar to one of them."""
    token, n, _, m = rows[:4]
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    more = np.flatnonzero(100 * n >= percent * (2 << band))
    token, band = np.concatenate([token, token[more]]), np.concatenate([band, band[more] + 1])
    key = mix(token.view(U) + band.astype(U) * U(0x9E3779B97F4A7C15))
    return _as_batch(np.stack([key.view(np.int64), np.concatenate([m, m[more]]), np.concatenate([n, n[more]])]), ["run", "m", "n"])


def _runs(percent: int):
    """Postings (token, n, place, class) as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _bands(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]), percent)

    return run


def _with_maps(runs: DataFrame, maps: DataFrame) -> DataFrame:
    return runs.join(maps, "m").select("run", "n", "m", "bitmap")


def _skip(percent: int):
    """Over postings (token, n, place, class, group) sorted by token, size and position: what may link two groups.

    Of two similar sets, the smaller one (or the first of equal ones) stands before the other in the list of their first common
    token, and the other's size is at most its `largest_partner`. So a set is kept if the next set of another group is no
    larger than that (all after it are larger still), or if some set before it has a largest partner of its size or more and
    the last set of another group is in reach. All else, block by block, is skipped.
    """

    def blocks_of(rows: np.ndarray, most_before: int, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Which rows to keep, which to hold back as their next block is not known, and the largest partner of the last list."""
        token, n, place, _, group = rows
        size = rows.shape[1]
        list_first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        list_no = np.repeat(np.arange(len(list_first)), np.diff(np.append(list_first, size)))
        block_first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
        block_no = np.repeat(np.arange(len(block_first)), np.diff(np.append(block_first, size)))
        after = np.append(block_first, size)[block_no + 1]
        at = np.minimum(after, size - 1)
        reach = largest_partner(n, place, percent)
        forth = (after < size) & (token[at] == token) & (n[at] <= reach)
        # The running maximum of `reach` within each list: lists are set apart by steps larger than any size.
        step = int(max(reach.max(), most_before, 0)) + 1
        own = np.maximum(reach, -1) + list_no * (step + 1)
        if most_before >= 0:
            own[0] = max(own[0], most_before)
        most = np.maximum.accumulate(own) - list_no * (step + 1)
        prior = np.concatenate([[most_before], most[:-1]])
        prior[list_first[1:]] = -1
        before = block_first[block_no] - 1
        other = (before >= 0) & (token[np.maximum(before, 0)] == token) & (100 * n[np.maximum(before, 0)] >= percent * n)
        other |= (before < 0) & (most_before >= 0)  # what stood before in this list is gone, so it counts as another group
        keep = forth | ((prior >= n) & other)
        hold = np.zeros(size, bool) if last else block_no == block_no[-1]
        return keep, hold, int(most[-1])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Held back are the rows of the last block; `most` is the largest partner of what stood before them in their list.
        held, most = np.zeros((5, 0), np.int64), -1
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if not new.shape[1]:
                continue
            rows = np.concatenate([held, new], 1)
            if held.shape[1] == 0 or rows[0, 0] != held[0, 0]:
                most = -1
            keep, hold, _ = blocks_of(rows, most, False)
            if hold.sum() > _HELD:
                keep, hold = keep | hold, np.zeros_like(hold)
                hold[-1] = True
            first = int(np.flatnonzero(hold)[0])
            yield _bands(rows[:, keep & ~hold], percent)
            reach = largest_partner(rows[1, :first], rows[2, :first], percent)[rows[0, :first] == rows[0, -1]]
            most = max(int(reach.max()) if len(reach) else -1, most if rows[0, 0] == rows[0, -1] else -1)
            held = rows[:, hold]
        if held.shape[1]:
            keep, _, _ = blocks_of(held, most, True)
            yield _bands(held[:, keep], percent)

    return lists


def _gather(percent: int, leaders: bool = False):
    """Over rows (run, n, class, bitmap) sorted by run and size: links that keep together what may be similar.

    A set joins the groups of all leaders within `reach` and becomes a leader itself if none is near. If x is near leader A, y near leader
    B, and x and y are similar, then A and B differ by at most three such steps, which `reach` covers; so they are joined. All
    bitmaps of a run are folded to the size of the first. With `leaders`, the leaders are returned, too, as rows (run, n, class, bitmap).
    """
    c = (100 - percent) / (100 + percent)
    reach = c * (1 + 200 / percent) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size = None, 0
        maps, sizes, names, used = np.zeros((0, 0), U), np.zeros(0), np.zeros(0, np.int64), 0
        parent: list[int] = []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for batch in batches:
            a, b, led = [], [], []
            runs, ns, reps, bitmaps = (batch.column(i) for i in range(4))
            for r, n, rep, raw in zip(runs.to_pylist(), ns.to_pylist(), reps.to_pylist(), bitmaps.to_pylist(), strict=True):
                own = np.frombuffer(raw, U)
                if r != key:
                    key, size, used = r, len(own), 1
                    if maps.shape[1] != size:
                        maps, sizes, names = np.zeros((8, size), U), np.zeros(8), np.zeros(8, np.int64)
                    maps[0], sizes[0], names[0] = own, n, rep
                    parent[:] = [0]
                    led.append((r, n, rep, raw))
                    continue
                own = _fold(own, size)
                away = np.bitwise_count(maps[:used] ^ own).sum(1)
                both = sizes[:used] + n
                groups = sorted({find(i) for i in np.flatnonzero(away <= reach * both).tolist()})
                if groups:
                    a.append(rep)
                    b.append(int(names[groups[0]]))
                for g in groups[1:]:
                    parent[g] = groups[0]
                    a.append(int(names[g]))
                    b.append(int(names[groups[0]]))
                if not ((away <= c * both + 1e-9) & (100 * np.minimum(sizes[:used], n) >= percent * np.maximum(sizes[:used], n))).any():
                    if used == len(maps):
                        maps, sizes, names = (np.concatenate([x, np.zeros_like(x)]) for x in (maps, sizes, names))
                    maps[used], sizes[used], names[used] = own, n, rep
                    parent.append(groups[0] if groups else used)
                    used += 1
                    led.append((r, n, rep, raw))
            links = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            yield _with_leaders(links, led) if leaders else links

    return run


def _with_leaders(links: pa.RecordBatch, led: list[tuple]) -> pa.RecordBatch:
    none = pa.nulls(len(led), pa.int64())
    columns = [pa.concat_arrays([c, none]) for c in links.columns]
    for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())):
        columns.append(pa.concat_arrays([pa.nulls(links.num_rows, kind), pa.array([x[i] for x in led], kind)]))
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "run", "n", "m", "bitmap"])


def _as_sets(k: int):
    """The sets of texts, of those that have the mark of their class."""

    def run(b: Block) -> pa.RecordBatch:
        h, first = shingles(b, k)
        mark = _marks(h, first)
        own = np.flatnonzero((mark[0] == b.column("m").to_numpy(zero_copy_only=False)) & (mark[1] == b.column("m2").to_numpy(zero_copy_only=False)))
        names = [x for x in b.batch.schema.names if x not in ("m", "m2", "text")]
        sets = pa.array([h[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())
        return pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(own)) for x in names), sets], [*names, "tokens"])

    return per_block(run, lower=True)


def set_marks(texts: DataFrame, words: int = 5) -> DataFrame:
    """texts (doc_id, text; no nulls) with the mark of each set, as jaccard_join() names it: two numbers."""

    def run(b: Block) -> pa.RecordBatch:
        mark = _marks(*shingles(b, words))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(mark[0]), pa.array(mark[1])], ["doc_id", "text", "mark_a", "mark_b"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_block(run, lower=True), "doc_id long, text string, mark_a long, mark_b long")


class _Lists:
    """Index lists of some sets: for each token the sets that hold it, in order of size, and its position in them."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self.n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, self.token = np.unique(flat, return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        owner = np.repeat(np.arange(len(sets)), self.n)
        place = np.arange(len(flat)) - np.repeat(self.first[:-1], self.n)
        # A list is sorted by size, then position, so that blocks of it can be skipped by either.
        order = np.lexsort((place, self.n[owner], self.token))
        self.owner, self.place = owner[order], place[order]
        self.cut = np.searchsorted(self.token[order], np.arange(self.token.max() + 2))
        self.size = self.n[self.owner]

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.first[i] : self.first[i + 1]]

    def members(self, tokens: np.ndarray) -> np.ndarray:
        """The lists of some tokens, one after the other."""
        size = self.cut[tokens + 1] - self.cut[tokens]
        at = np.repeat(self.cut[tokens] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(tokens) else np.zeros(0, np.int64)
        return self.owner[at]

    def may_link(self, i: int) -> bool:
        """Whether any other set shares a token of the prefix of i where size and position leave enough to share."""
        n, p = int(self.n[i]), self.percent
        for j, t in enumerate(self.tokens(i)[: n - int(needed(self.n[i], p)) + 1]):
            lo, hi = self.cut[t], self.cut[t + 1]
            lo, hi = lo + np.searchsorted(self.size[lo:hi], -(-p * n // 100)), lo + np.searchsorted(self.size[lo:hi], 100 * n // p, "right")
            m, at = self.size[lo:hi], self.place[lo:hi]
            share = np.minimum(at, j) + 1 + np.minimum(m - at - 1, n - j - 1)
            if ((100 + p) * share >= p * (n + m)).sum() > 1:
                return True
        return False

    def answers(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each set with the sets that are similar to it (without itself)."""
        order = np.lexsort((self.n,))
        known, overlap = None, None
        for i in order.tolist():
            mine = self.tokens(i)
            if known is not None:
                theirs = self.tokens(known)
                less, more = np.setdiff1d(theirs, mine, assume_unique=True), np.setdiff1d(mine, theirs, assume_unique=True)
            if known is not None and 4 * (len(less) + len(more)) <= len(mine):
                overlap = overlap - np.bincount(self.members(less), minlength=len(self.n)) + np.bincount(self.members(more), minlength=len(self.n))
            elif self.may_link(i):
                overlap = np.bincount(self.members(mine), minlength=len(self.n))
            else:
                yield i, np.zeros(0, np.int64)
                continue
            known = i
            alike = np.flatnonzero(100 * overlap >= self.percent * (self.n[i] + self.n - overlap))
            yield i, alike[alike != i]


def _verify(percent: int):
    """Over rows sorted by group and block pair: classes with the documents linked to them, and their local root."""

    def group(rows: list[tuple], two: bool) -> Iterator[tuple[int, int, int]]:
        rep = np.array([r[0] for r in rows])
        size = np.array([r[1] for r in rows])
        side = np.array([r[2] for r in rows])
        lists = _Lists([np.frombuffer(r[3], U) for r in rows], percent)
        parent = list(range(len(rows)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = np.zeros(len(rows), np.int64)
        for i, alike in lists.answers():
            if two:
                alike = alike[side[alike] != side[i]]
            links[i] = size[alike].sum()
            for j in alike[alike < i].tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[a if rep[a] > rep[b] else b] = b if rep[a] > rep[b] else a
        for i in np.flatnonzero(links).tolist():
            yield int(rep[i]), int(rep[find(i)]), int(links[i])

    def batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for rb in batches:
            columns = [rb.column(rb.schema.get_field_index(c)).to_pylist() for c in ("root", "i", "j", "cid", "size", "block", "tokens")]
            for root, i, j, *row in zip(*columns, strict=True):
                if (root, i, j) != key:
                    if len(rows) > 1:
                        out += group(rows, key[1] != key[2])
                    key, rows = (root, i, j), []
                    if len(out) > 5000:
                        yield batch(out)
                        out = []
                rows.append(tuple(row))
        if len(rows) > 1:
            out += group(rows, key[1] != key[2])
        yield batch(out)

    return run


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """Documents linked if 100 * |intersection| >= percent * |union| of their sets of shingles.

    Returns a row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included),
    class_id (the smallest id with the same set) and n_links (how many other rows are linked to it). With `marks` also mark_a and
    mark_b, which tell the texts of one id apart by their sets (see set_marks; null without a set).
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(heavy_levels(rows.select("text"), words, low_share(percent)))
    sets = scratch.stored(rows.mapInArrow(_sets(words, percent, levels), "doc_id long, n long, m long, m2 long, low long, bitmap binary"))
    whole = sets.where("doc_id IS NOT NULL AND n > 0")
    # A class is named by a number of its own. In the index m stands for it, as texts know it; should two classes ever share an m,
    # both are verified wherever one would be.
    classes = whole.groupBy("m", "m2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low"), F.count(F.lit(1)).alias("size"))
    classes = scratch.stored(classes.withColumn("cid", F.monotonically_increasing_id()))

    named = rows.where("doc_id IS NOT NULL").select("text").mapInArrow(_postings(words, percent, levels), "token long, m long, place int")
    shared = scratch.stored(named.repartition("token").sortWithinPartitions("token", "m").mapInArrow(_shared, "token long, m long, place long"))
    of_set = Window.partitionBy("m")
    light = F.count_if((F.col("token") >= 0) & (F.col("token") < int(low_share(percent) * 2.0**TOKEN_BITS)))
    slack = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    left = shared.join(classes.groupBy("m").agg(F.max("n").alias("n"), F.min("low").alias("low")), "m")
    left = left.withColumn("shared", light.over(of_set)).where(F.col("low") - F.col("shared") <= slack).where(F.col("place") <= slack)
    left = left.withColumn("rank", F.row_number().over(of_set.orderBy("place")))
    left = scratch.stored(left.select("token", "n", "place", "m", "rank"))
    scratch.drop(shared)
    # Bitmaps of equal sets are reduced to one before they are shuffled.
    maps = scratch.stored(whole.groupBy("m").agg(F.first("bitmap").alias("bitmap")).join(left.where("rank = 1").select("m"), "m"))

    first = _with_maps(left.where(f"rank <= {_FIRST}").select("token", "n", "place", "m").mapInArrow(_runs(percent), "run long, m long, n long"), maps)
    gathered = "a long, b long, run long, n long, m long, bitmap binary"
    leaders = scratch.stored(first.sortWithinPartitions("run", "n", "m").mapInArrow(_gather(percent, True), gathered))
    between = leaders.where("bitmap IS NOT NULL").select("run", "n", "m", "bitmap").repartition("run").sortWithinPartitions("run", "n", "m").mapInArrow(_gather(percent), "a long, b long")
    groups = components(leaders.where("bitmap IS NULL").select("a", "b").unionByName(between))
    scratch.drop(leaders)

    labelled = left.join(groups.withColumnRenamed("u", "m"), "m", "left").select("token", "n", "place", "m", F.coalesce("root", "m").alias("group"))
    # Lists of one group are found by partial sums and never brought together; a hot token is split by the join.
    mixed = labelled.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("token")
    lists = labelled.join(mixed, "token", "left_semi").repartition("token").sortWithinPartitions("token", "n", "place", "m").mapInArrow(_skip(percent), "run long, m long, n long")
    links = _with_maps(lists, maps).repartition("run").sortWithinPartitions("run", "n", "m").mapInArrow(_gather(percent), "a long, b long")
    near = components(links.unionByName(groups.select(F.col("u").alias("a"), F.col("root").alias("b"))))
    scratch.drop(left, maps)

    roots = near.select("root").distinct().select(F.col("root").alias("u"), "root")
    grouped = scratch.stored(near.unionByName(roots).withColumnRenamed("u", "m").join(classes.select("cid", "m", "m2", "rep", "n", "size"), "m"))
    shape = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    near = grouped.join(shape, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A class is verified by one text; only those of rows that repeat id and set are shuffled to be reduced to one.
    twice = whole.groupBy("doc_id", "m", "m2").count().where("count > 1").select(F.col("doc_id").alias("rep"), "m", "m2", F.lit(True).alias("again"))
    wanted = scratch.stored(near.join(twice, ["rep", "m", "m2"], "left").select("root", "cid", "rep", "m", "m2", "again", "size", "blocks", "block"))
    scratch.drop(grouped)
    # A few numbers per class go to every executor while they are few; beyond that, texts and classes are shuffled.
    few = wanted.count() <= BROADCAST_ROWS

    def sets_of(some: DataFrame) -> DataFrame:
        texts = rows.join(F.broadcast(some) if few else some, rows.doc_id == some.rep)
        return texts.select("root", "cid", "m", "m2", "size", "blocks", "block", "text").mapInArrow(_as_sets(words), "root long, cid long, size long, blocks int, block int, tokens binary")

    found = sets_of(wanted.where("again IS NULL")).unionByName(sets_of(wanted.where("again")).dropDuplicates(["cid"]))
    dealt = found.select("root", "cid", "size", "block", "tokens", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "size", "block", "tokens")
    checked = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "cid").mapInArrow(_verify(percent), "a long, b long, links long")
    checked = scratch.stored(checked)
    scratch.drop(wanted)

    joined = components(checked.select("a", "b"))
    members = joined.unionByName(joined.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "cid").join(classes.select("cid", "rep"), "cid")
    smallest = members.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = members.select("cid", "root").join(smallest, "root").select("cid", "component")
    counts = checked.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    of_class = classes.join(of_class, "cid", "left").join(counts, "cid", "left")
    of_class = of_class.select("m", "m2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("m")).alias("m"), "m2").join(of_class, ["m", "m2"], "left")
    told = [F.col("m").alias("mark_a"), F.when(F.col("m").isNotNull(), F.col("m2")).alias("mark_b")] if marks else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), *told)
