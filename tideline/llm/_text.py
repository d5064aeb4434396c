"""Vectorised text primitives that run inside Arrow batches on the executors.

Everything here works on one contiguous UTF-8 buffer per block of documents, so
cost per byte does not depend on how long single documents are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once; bounds the working memory of a task.
BLOCK_BYTES = 2_000_000
_P, _Q = 0x9E3779B97F4A7C17, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on unsigned arrays and wraps."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        inverse = pow(base, -1, 2**64)
        both = []
        for b in (base, inverse):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _Q):
        forward, self.back = _power(base, len(values))
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * forward[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U64))


class Block:
    """Some documents of a batch: ids, and their bytes in one buffer with offsets."""

    def __init__(self, first: int, ids: np.ndarray, buf: np.ndarray, offs: np.ndarray):
        self.first, self.ids, self.buf, self.offs = first, ids, buf, offs

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def rolling_bytes(self) -> Rolling:
        return Rolling(_TABLE[self.buf], _P)

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block: byte ranges, hashes, and the first word of each document."""

    def __init__(self, block: Block, lower: bool):
        buf, offs = block.buf, block.offs
        solid = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        before = np.empty_like(solid)
        before[:1] = True
        np.logical_or(~solid[:-1], edge[1:-1], out=before[1:])
        after = np.empty_like(solid)
        after[-1:] = True
        np.logical_or(~solid[1:], edge[1:-1], out=after[:-1])
        self.start = np.flatnonzero(solid & before)
        self.stop = np.flatnonzero(solid & after) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.hash = Rolling(_TABLE[LOWER[buf] if lower else buf], _P).hash(self.start, self.stop)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The document's index of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indexes) of the windows inside one document, and their hashes."""
        room = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.start))
        at = np.flatnonzero(room >= size)
        return at, Rolling(self.hash).hash(at, at + size)


def blocks(batch: pa.RecordBatch, column: str = "text", key: str = "doc_id", max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut an Arrow batch into blocks of about max_bytes; a longer document is a block of its own. Null texts are empty."""
    ids = np.asarray(batch.column(key).fill_null(0) if batch.num_rows else [], dtype=np.int64)
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield Block(i, ids[i:j], buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True."""
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """True where one of the ranges lies, within 0..n."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(starts, n), 1)
    np.add.at(delta, np.minimum(stops, n), -1)
    return np.cumsum(delta[:n]) > 0


def ints(parts: list[bytes] | None) -> np.ndarray:
    """Packed 32-bit integers back from a list of binaries."""
    return np.frombuffer(b"".join(parts), np.int32) if parts is not None and len(parts) else np.zeros(0, np.int32)


def by_key(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Rows of each key, keys ascending, order within a key kept."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], tuple(c[order] for c in columns)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)])), strict=True):
        yield int(keys[a]), tuple(c[a:b] for c in columns)
