"""Numpy kernels on blocks of whole texts, and the Arrow scans that feed them.

A block is the UTF-8 bytes of several whole documents, one space apart, and at most BLOCK_BYTES long unless a single
document is longer.  All kernels work on a block at once, so Python does nothing per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_TABLES: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64, kept between blocks."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 64)
        made = []
        for base in (BASE, BASE_INVERSE):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            made.append(np.cumprod(out))
        have = _TABLES["powers"] = tuple(made)
    return have[0][:n], have[1][:n]


def byte_tables() -> dict[str, np.ndarray]:
    """Lookup tables over byte values: white space, A-Z lowered, and a random 64-bit value of each byte."""
    if "bytes" not in _TABLES:
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _TABLES["bytes"] = {"space": space, "lower": lower, "value": mix(np.arange(1, 257, dtype=np.uint64))}
    return _TABLES["bytes"]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: spreads a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of values[start:end] for each pair, independent of where the range lies."""
    p, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Whole documents joined by one space: bytes, and where each document starts and ends."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n = len(texts)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        if lower:
            self.bytes = byte_tables()["lower"][self.bytes]
        self._words: tuple | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word, a maximal run of bytes other than ASCII white space."""
        if self._words is None:
            space = byte_tables()["space"][self.bytes]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            self._words = starts, ends, np.searchsorted(self.starts, starts, side="right") - 1
        return self._words

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return range_hash(byte_tables()["value"][self.bytes], starts, ends)

    def count(self, doc_of_each: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc_of_each, weights=weights, minlength=self.n)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and Rabin-Karp hash of each run of k words that lies in one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, range_hash(hashes, at, at + k)


def window_minima(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start s (ascending), the place of the smallest of values[s:s+width], the left-most of equals.

    Prefix and suffix minima of pieces of ``width`` values answer any window with two lookups.  A value keeps its upper 40
    bits; the lower 24 hold its place, so that equal values fall to the left.
    """
    out = np.empty(len(starts), dtype=np.int64)
    step, low = 1 << 23, np.uint64((1 << 24) - 1)
    for lo in range(0, len(values), step):
        i, j = np.searchsorted(starts, [lo, lo + step])
        if i == j:
            continue
        part = values[lo : lo + step + width]
        rows = -(-len(part) // width) + 1
        keyed = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        keyed[: len(part)] = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        grid = keyed.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = starts[i:j] - lo
        out[i:j] = (np.minimum(behind[at], ahead[at + width - 1]) & low).astype(np.int64) + lo
    return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of [start, end) for each pair, one pair after another; pairs with end <= start give none."""
    sizes = np.maximum(ends - starts, 0)
    total = int(sizes.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into runs of rows of at most ``limit`` text bytes; a null text counts as empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > limit:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t) + 1
        if len(texts) > at:
            yield batch.slice(at), texts[at:]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def scan(df: DataFrame, schema: str, kernel: Callable[[pa.RecordBatch, list[bytes]], dict], text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Maps each block of rows through ``kernel``, which returns one array or list for each output column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text, limit):
            out = kernel(batch, texts)
            yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)
