"""Numpy kernels over whole Arrow batches of text.

A batch of texts is one contiguous UTF-8 buffer plus row offsets, so words and
shingles of every row are found with a fixed number of array operations; there
is no Python loop over rows or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_SEED = U64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 1 where a byte is one of the separators [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(29)
    h *= _M2
    h ^= h >> U64(32)
    return h


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as (start, end, first-word index of each row); words never cross rows."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = word[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    if len(start) == 0:
        return np.zeros(0, U64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    size = end - start
    h = mix((size.astype(U64) + U64(1)) * _SEED)
    live = np.arange(len(start))
    k = 0
    while len(live):
        left = size[live] - k
        chunk = at[start[live] + k] & _MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ chunk) * _SEED + U64(k + 1))
        k += 8
        live = live[left > 8]
    return h


def multipliers(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=U64) * _SEED) | U64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, row) of every window of ``width`` words; a row with fewer words,
    but at least one, has its whole sequence as its only shingle."""
    n_words = np.diff(first)
    mult = multipliers(width)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    m = max(len(hashes) - width + 1, 0)
    total = np.zeros(m, U64)
    for j in range(width):
        total += hashes[j : j + m] * mult[j]
    inside = row_of[:m] == row_of[width - 1 : width - 1 + m]
    value, row = mix(total[inside]), row_of[:m][inside]
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        h = n_words[few].astype(U64) * _SEED
        for j in range(width - 1):
            has = n_words[few] > j
            h[has] += hashes[first[few[has]] + j] * mult[j]
        value, row = np.concatenate([value, mix(h)]), np.concatenate([row, few])
    return value, row


def distinct_in_rows(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, rows ascending."""
    order = np.argsort(value, kind="quicksort")
    value, row = value[order], row[order]
    order = np.argsort(row, kind="stable")
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], row[keep]
