"""Words, windows and their hashes for whole batches of texts at once, on numpy arrays.

Hashes are polynomials modulo 2^64 over random numbers for the bytes. Powers and inverse
powers of an odd base give the hash of any stretch from two prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 3 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(start + np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))


BYTES = draws(256, 1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {1: (np.ones(1, "u8"), np.ones(1, "u8"))}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    up, down = _powers[1]
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype="u8"), np.cumprod(down, dtype="u8")
        _powers[1] = up, down
    return up[:n], down[:n]


class Stretches:
    """Hashes of stretches of an array of 64-bit numbers."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, "u8")
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(found ^ (np.uint64(0xD6E8FEB86659FD93) * (end - start).astype("u8")))


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text starts (and the last one ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "")
    wide = "i8" if pa.types.is_large_string(texts.type) else "i4"
    if not len(texts):
        return np.empty(0, "u1"), np.zeros(1, "i8")
    _, places, data = texts.buffers()
    at = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    if data is None:
        return np.empty(0, "u1"), at - at[0]
    return np.frombuffer(data, "u1")[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", size: int = PIECE_BYTES) -> Iterator:
    """Slices of a batch with about ``size`` bytes of text each, whole texts always."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run ends where its text does."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = inside & (edge[:n] | ~np.concatenate(([False], inside[:-1])))
    last = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data``, their hash, and the
    number of the first word of each text in ``first``."""

    def __init__(self, texts, table: np.ndarray = BYTES):
        self.data, self.at = buffer(texts)
        self.start, self.end = runs(~SPACE[self.data], self.at)
        self.hash = Stretches(table[self.data])(self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``n`` words inside one text, and their hashes."""
        return windows(self.hash, self.first, n)


def windows(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all stretches of ``n`` values within the parts that begin at
    ``first``."""
    starts = within(first, n)
    if not len(starts):
        return starts, np.empty(0, "u8")
    return starts, Stretches(values)(starts, starts + n)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """The places from which ``n`` values lie in the same part."""
    total = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(room >= n)
