"""Words and word shingles of Arrow string columns as 64-bit numbers, without a Python loop over words.

The hash of a word is a polynomial of its lower-cased bytes, taken from prefix sums modulo 2**64;
a word's place in its buffer is divided out with the inverse of the base, which is odd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Bytes of text that are hashed at a time; longer texts are cut between words.
CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U64)


_POW = _powers(_BASE, CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _words_of(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of each word. No word runs over a start of a text."""
    n = len(data)
    is_word = _WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[starts_of_texts[starts_of_texts <= n]] = True
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, is_word[:-1]
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, is_word[1:]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    power, inverse = (_POW, _INV) if n < len(_POW) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * power[:n], out=sums[1:], dtype=U64)
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, starts, ends


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a long text behind characters that are in no word."""
    at = 0
    while len(data) - at > CHUNK:
        gaps = np.flatnonzero(~_WORD[data[at : at + CHUNK]])
        if not len(gaps):
            gaps = np.flatnonzero(~_WORD[data[at:]])
        end = at + int(gaps[-1 if gaps.size and gaps[-1] < CHUNK else 0]) + 1 if len(gaps) else len(data)
        yield at, end
        at = end
    yield at, len(data)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of about CHUNK bytes: first row, row after the last, the bytes, and of each word its
    row (from the first), hash, start and end in these bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        own, at = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        if len(own) <= CHUNK:
            found = _words_of(own, at)
        else:
            parts = [(a, _words_of(own[a:b], np.zeros(1, np.int64))) for a, b in _pieces(own)]
            found = tuple(np.concatenate([p[i] + (a if i else 0) if i else p[0] for a, p in parts]) for i in range(3))
        hashes, starts, ends = found
        yield row, last, own, np.searchsorted(at, starts, "right") - 1, hashes, starts, ends
        row = last


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a row, and where it starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * U64(_BASE) + hashes[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 : k - 1 + n])
    return mix(out[at]), at
