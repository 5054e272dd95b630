"""Words of whole texts, a block of documents at a time, with numpy inside Spark tasks.

A word is a run of bytes other than ASCII white space (`[^\\x20\\x09-\\x0D]+`). A block holds some documents of an Arrow
batch, about BLOCK_BYTES of text and one document at least, so that memory does not grow with the table. Hashes are
polynomials modulo 2**64 over bytes (for words and lines) or word hashes (for windows), made from prefix sums; spans of over
LONG_SPAN bytes are hashed by xxh3 instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
LONG_SPAN = 512

U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES // 2)
        up, down = np.empty(size, U), np.empty(size, U)
        up[0] = down[0] = 1
        up[1:], down[1:] = U(_BASES[which]), U(pow(_BASES[which], -1, 1 << 64))
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * BLOCK_BYTES:
            _powers[which] = have
    return have


def window_hash(h: np.ndarray, starts: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of the k values of h from each of starts."""
    up, down = _power(len(h), which)
    total = np.zeros(len(h) + 1, U)
    np.cumsum((mix(h + U(which)) if which > 1 else h) * up[: len(h)], out=total[1:])
    return mix((total[starts + k] - total[starts]) * down[starts])


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # in stretches, so that memory follows BLOCK_BYTES and not the longest document
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        if to == at + 1 and hi - lo > LONG_SPAN:
            out[at] = 0
        else:
            up, down = _power(hi - lo, 0)
            total = np.zeros(hi - lo + 1, U)
            np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        at = to
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


class Block:
    """Some documents: their bytes one after the other, and their words."""

    def __init__(self, batch: pa.RecordBatch, text: str, lower: bool = False) -> None:
        self.batch = batch
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, values = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = (np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8))[off[0] : off[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.off = off - off[0]
        self.n = len(column)
        space = _SPACE[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.off] = True
        word = ~space
        before = np.empty(len(word), bool)
        before[:1], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(word & (before | first[:-1]))
        after = np.empty(len(word), bool)
        after[-1:], after[:-1] = True, space[1:]
        self.end = np.flatnonzero(word & (after | first[1:])) + 1
        self.word_byte = word
        #: The number of the first word of each document, and of all words.
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), self.count)

    def windows(self, k: int) -> np.ndarray:
        """Numbers of the words from which k words of one document start."""
        last = np.repeat(self.first[1:], self.count)
        return np.flatnonzero(np.arange(len(last)) + k <= last)

    def per_doc(self, byte_mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask holds."""
        total = np.zeros(len(byte_mask) + 1, np.int64)
        np.cumsum(byte_mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of each document."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def words_of(self, i: int) -> list[bytes]:
        return self.text_bytes(i).split()


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about limit bytes of text, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def blocks(batch: pa.RecordBatch, text: str, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a batch in blocks of about limit bytes."""
    for some in slices(batch, text, limit):
        yield Block(some, text, lower)


def per_block(fn: Callable[[Block], pa.RecordBatch | Iterable[pa.RecordBatch] | None], text: str = "text", lower: bool = False):
    """For mapInArrow: fn over the blocks of every batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, lower):
                out = fn(block)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return run


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts key, and the starts of runs of equal values in that order."""
    order = np.argsort(key)
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values of key occur twice or more."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        both = np.zeros(len(key), bool)
        both[1:] |= same
        both[:-1] |= same
        out[order] = both
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in the k places from any of starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:n]) > 0


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
