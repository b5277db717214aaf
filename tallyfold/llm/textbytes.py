"""Words of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and afterwards the memory that it no longer uses goes back to the system: a worker stays alive for other tasks."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return once


SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8)
    at -= at[0]
    if column.null_count:  # a null may still own bytes
        gone = np.asarray(column.is_null())
        if np.any(np.diff(at)[gone]):
            return flat(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return data, at


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text each, so that working arrays stay small; a longer text is a slice of its own."""
    _, at = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of the rows of a column: start and end byte, row, and a 64-bit hash of the bytes with A-Z lower-cased."""

    _space = np.zeros(256, bool)
    _space[list(SPACES)] = True
    _letter = seeded(256, 11)
    _letter[65:91] = _letter[97:123]
    _letter[list(SPACES)] = 0
    _base = U(0x9FB21C651E98DF25)
    _power = np.ones(1, U)
    _inverse = np.ones(1, U)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) < n:
            n = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("_power", int(cls._base)), ("_inverse", pow(int(cls._base), -1, 1 << 64))):
                    full = np.full(n, U(base), U)
                    full[0] = 1
                    setattr(cls, name, np.cumprod(full, dtype=U))
        return cls._power, cls._inverse

    def __init__(self, column: pa.Array, hashes: bool = True) -> None:
        self.data, self.at = data, at = flat(column)
        self.rows = len(at) - 1
        n = len(data)
        solid = ~self._space[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        full = np.flatnonzero(np.diff(at))
        begin[at[full]] = solid[at[full]]
        end[at[full + 1] - 1] = solid[at[full + 1] - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.row = np.searchsorted(at, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows) if len(self.row) else np.zeros(self.rows, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        if hashes:
            if not len(self.start):
                self.hash = np.zeros(0, U)
                return
            power, inverse = self._powers(n)
            with np.errstate(over="ignore"):
                total = np.add.reduceat(self._letter[data] * power[:n], self.start)
                self.hash = mix(total * inverse[self.start] + (self.end - self.start).astype(U) * U(0x9E3779B97F4A7C15))


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word windows; with fewer words the whole sequence as one; none without words."""
    weights = seeded(k + 1, 29) | U(1)
    h, out = words.hash, []
    if len(h) >= k:
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) - k + 1, U)
            for j in range(k):
                total += h[j : j + len(total)] * weights[j]
            total = mix(total)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(h[a:b] * weights[: b - a]).sum(dtype=U) + weights[k] * U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out
