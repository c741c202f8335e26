"""Byte-level tokenising and shingling of Arrow string columns with numpy.

Words are runs of bytes outside a separator set. All separators used here are
ASCII, so byte runs in UTF-8 equal code point runs, and A-Z is lower-cased per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def _separated(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Word bytes after lower-casing, as [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F].
SPACED = _separated((0x20, 0x20), (0x09, 0x0D))
ALNUM = _separated((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=U64) | U64(1)
_ORDER_MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=U64) | U64(1)
_powers_cache: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers_cache[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_MULTIPLIER, -1, 2**64)
        for k, base in enumerate((_MULTIPLIER, inverse)):
            factors = np.full(size, base, U64)
            factors[0] = 1
            _powers_cache[k] = np.cumprod(factors)
    return _powers_cache[0][:n], _powers_cache[1][:n]


class Words(NamedTuple):
    """Words of some documents, in order; first[d]:first[d+1] are those of document d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lowered: np.ndarray

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.lowered[self.starts[i] : self.ends[i]].tobytes()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole documents, about `limit` bytes at a time."""
    raw, at = utf8(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACED) -> Words:
    """Lower-case (A-Z only) and cut into words; a word never spans two documents."""
    lowered = LOWER[raw]
    inside = kind[lowered]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(at), np.int64), lowered)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[at < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[lowered] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return Words(hashes, starts, ends, np.searchsorted(starts, at).astype(np.int64), lowered)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and their offsets by document.

    A document of fewer than k words, but not none, has one: its whole sequence.
    """
    count = np.diff(w.first)
    n = len(w.hashes)
    amount = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(amount)])
    out = np.zeros(first[-1], U64)
    if n >= k:
        total = np.zeros(n - k + 1, U64)
        for j in range(k):
            total += w.hashes[j : n - k + 1 + j] * _ORDER_MULTIPLIERS[j]
        document = w.documents()
        full = document[: n - k + 1] == document[k - 1 :]
        out[np.repeat(count >= k, amount)] = total[full]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            total[has] += w.hashes[w.first[short[has]] + j] * _ORDER_MULTIPLIERS[j]
        out[first[short]] = total + count[short].astype(U64) * _ORDER_MULTIPLIERS[63]
    return mix(out), first
