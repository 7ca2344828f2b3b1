"""Rolling polynomial (Rabin-Karp) hashes in numpy over the concatenated texts of a slice.

Two families. ``window_hashes`` works modulo 2^64: fast, and good for routing, sampling and short
windows. ``window_pairs`` decides equality: two moduli-2^61-1 polynomials at independent bases over
128-bit word symbols, 122 bits in all. (A polynomial modulo 2^64 collides on Thue-Morse words of
1024 letters whatever its base, so no long word is ever hashed by one.)
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@lru_cache(maxsize=2)
def _table(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    return _table(int(base), max(1 << 21, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of x over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes in one array, and where each row begins (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (a run without ASCII white space), and each row's first word."""
    inside = ~_SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside[1:], False) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


class Symbols(dict):
    """A number for each word met, and the two 61-bit symbols (from its XXH3-128) of each number."""

    MOST = 1 << 17

    def __init__(self) -> None:
        super().__init__()
        self.digests: list[bytes] = []
        self.table = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.MOST:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.digests:
            new = np.frombuffer(b"".join(self.digests), "<u8").reshape(-1, 2) >> np.uint64(3)
            self.table = np.concatenate([self.table, new])
            self.digests.clear()
        return self.table[at, 0], self.table[at, 1]


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word; equal words, equal hashes."""
    data = raw.tobytes()
    known: dict[bytes, int] = {}
    out = np.empty(len(begins), np.uint64)
    for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        word = data[a:b]
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
        out[k] = known[word]
    return out


_P61 = np.uint64((1 << 61) - 1)
_BLOCK = 1 << 13
#: Two bases for polynomials modulo 2^61 - 1.
BASES = (0x0B7E151628AED2A6, 0x13198A2E03707344)


def _fold61(x: np.ndarray) -> np.ndarray:
    x = (x & _P61) + (x >> np.uint64(61))
    return np.minimum(x, x - _P61)  # below the modulus, the difference wraps around to a greater value


def times61(x: np.ndarray, by: int) -> np.ndarray:
    """x * by modulo 2^61 - 1, for x below 2^61, from 32-bit halves: no product leaves 64 bits."""
    low, high, half = np.uint64(by & 0xFFFFFFFF), np.uint64(by >> 32), np.uint64(32)
    x0, x1 = x & np.uint64(0xFFFFFFFF), x >> half
    middle = x1 * low + x0 * high
    lowest = x0 * low
    total = ((x1 * high) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half) + (lowest & _P61) + (lowest >> np.uint64(61))
    return _fold61(total)


def _windows61(symbols: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of each run of ``width`` symbols, by doubling."""
    prime = int(_P61)
    out, have, level, size = None, 0, _fold61(symbols), 1
    while True:
        if width & size:
            # the run grows at its front: ``size`` symbols before the ``have`` that are there
            n = len(symbols) - have - size + 1
            out = level[:n].copy() if out is None else _fold61(times61(level[:n], pow(base, have, prime)) + out[size : size + n])
            have += size
        if 2 * size > width:
            return out
        level = _fold61(times61(level[:-size], pow(base, size, prime)) + level[size:])
        size *= 2


def window_pairs(symbols: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 122-bit hash of each run of ``width`` words as (first 64 bits, last 58 bits and 6 zeros), by its begin."""
    n = max(0, len(symbols[0]) - width + 1)
    first, last = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):  # blocks that stay in a processor's cache
        a, b = (_windows61(s[at : at + _BLOCK + width - 1], width, base) for s, base in zip(symbols, BASES, strict=True))
        first[at : at + _BLOCK] = a << np.uint64(3) | b >> np.uint64(58)
        last[at : at + _BLOCK] = b << np.uint64(6)
    return first, last


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` symbols, by its begin; rows' edges are the caller's concern."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[: len(symbols)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(len(symbols), _INVERSE)[:n])


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


def byte_pairs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's two 61-bit symbols, for ``window_pairs``."""
    return (_BYTES >> np.uint64(3))[raw], (mix(_BYTES) >> np.uint64(3))[raw]


def binary_rows(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values that hold ``counts`` items of ``data`` each, without a copy per value."""
    ends = np.append(0, np.cumsum(counts) * data.dtype.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
