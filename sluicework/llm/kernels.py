"""Vectorised text kernels over Arrow string buffers: words, their hashes, n-grams.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text. Hashes are 64-bit polynomials over the word's bytes, computed for a whole slice of texts at once from
prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.RandomState(20240229)
BYTE_CODE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).view(U) | U(1)
GRAM_CODE = _rng.randint(1, 2**63 - 1, 64, dtype=np.int64).view(U) | U(1)
WORD_BYTE = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    WORD_BYTE[_c] = True
WORD_BYTE[128:] = True
#: The same words in SQL regular expressions (RE2 and Java).
WORD_REGEX = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of h over all 64 (bijective)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(max(20, int(n).bit_length()))
    return p[:n], q[:n]


def texts(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return body[at[0] :], at - at[0]


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of some texts: starts, ends (bytes), row of each, number by row, hash."""

    def __init__(self, body: np.ndarray, at: np.ndarray, word_byte: np.ndarray = WORD_BYTE):
        n = len(body)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word_byte[body]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        before, here = inside[:-1], inside[1:]
        self.start = np.flatnonzero(here & (~before | cut))
        self.end = np.flatnonzero(before & (~here | cut))
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(at) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = spans(body, self.start, self.end)


def spans(body: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of body[start:end] for many spans."""
    if not len(start):
        return np.zeros(0, U)
    total = prefix(body) if total is None else total
    inv = powers(len(body) + 1)[1]
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def prefix(body: np.ndarray) -> np.ndarray:
    p = powers(len(body) + 1)[0]
    total = np.zeros(len(body) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[body] * p[: len(body)], out=total[1:])
    return total


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number by row) of all word n-grams; a row of fewer words has one gram of all of them."""
    h, count = words.hash, words.count
    if n == 1:
        return mix(h * GRAM_CODE[0]), count
    with np.errstate(over="ignore"):
        k = max(0, len(h) - n + 1)
        g = np.zeros(len(h), U)
        for j in range(n):
            g[:k] += h[j : j + k] * GRAM_CODE[j]
        keep = np.zeros(len(h), bool)
        keep[:k] = words.row[:k] == words.row[n - 1 :] if k else False
        short = np.flatnonzero((count > 0) & (count < n))
        for j in range(n - 1):
            has = words.first[short[count[short] > j]]
            first = has if j == 0 else words.first[short[count[short] > j]]
            if j == 0:
                g[first] = U(0)
            g[first] += h[first + j] * GRAM_CODE[32 + j]
        keep[words.first[short]] = True
    return mix(g[keep]), np.where(count >= n, count - n + 1, np.minimum(count, 1))


def gram_sets(column: pa.Array, n: int, relabel=None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct gram hashes) of every text that has a word."""
    body, at = texts(column)
    for i, j in slices(at):
        lo, hi = at[i], at[j]
        g, count = grams(Words(body[lo:hi], at[i : j + 1] - lo), n)
        if relabel is not None:
            g = relabel(g)
        ends = np.cumsum(count)
        for k in np.flatnonzero(count):
            own = np.sort(g[ends[k] - count[k] : ends[k]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield i + int(k), own


def cells(own: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, side): one cell for each block that a row's own block meets.

    A cell is the pair i <= j of blocks, as a number; side is 0 where they are the same block, else 1 in i and 2 in j.
    """
    row = np.repeat(np.arange(len(own)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = own[row]
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    return row, high * (high + 1) // 2 + low, np.where(mine == other, 0, np.where(mine == low, 1, 2))


def thrifty(run: Callable) -> Callable:
    """run, after which the worker gives the memory that it doesn't use back to the system: an idle worker stays small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_zip, _unzip = None, None


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as a compressed block: first all lowest bytes of a column, then the next."""
    global _zip
    _zip = _zip or zstandard.ZstdCompressor(level=1)
    return _zip.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    global _unzip
    _unzip = _unzip or zstandard.ZstdDecompressor()
    raw = _unzip.decompress(block)
    width = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(width), [], 0
    for k, w in zip(kinds, width):
        out.append(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T.copy().view(k).ravel())
        at += n * w
    return out
