"""Vectorised words, word hashes and shingle hashes over Arrow text columns.

Texts are handled as UTF-8 bytes. A-Z is lower-cased and words are runs of
anything but the bytes 0x20 and 0x09-0x0D, so no Python string is made per word.
A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix
sums and mixed; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text worked on at once (a longer text is one slice).
SLICE_BYTES = 1 << 18
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        made = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(times)
    x ^= x >> U(31)
    return x


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1, first + 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = (data != 32) & ((data < 9) | (data > 13))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts = inside & (fresh[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (fresh[1:] | np.concatenate((~inside[1:], [True])))
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every lower-cased word, in order."""
    s, e, row = word_spans(data, offsets)
    return row, span_hashes(lower(data), s, e)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of each of the byte spans [s, e)."""
    if not len(s):
        return np.zeros(0, U)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``sequence_hash`` takes the hash of any run of ``values``."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def sequence_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of values[s:e], the same wherever the run stands."""
    return mix((sums[e] - sums[s]) * powers(len(sums))[1][s])


def shingle_hashes(row: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a text of fewer words is one shingle, one of none has none."""
    if not len(row):
        return row, words
    times = mix(np.arange(1, k + 1, dtype=U)) | U(1)
    n = len(words)
    out_row, out = [], []
    if n >= k:
        full = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        h = np.full(len(full), U(k), U)
        for j in range(k):
            h += words[full + j] * times[j]
        out_row.append(row[full])
        out.append(mix(h))
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    length = np.diff(np.append(first, n))
    for m in range(1, k):
        at = first[length == m]
        h = np.full(len(at), U(m), U)
        for j in range(m):
            h += words[at + j] * times[j]
        out_row.append(row[at])
        out.append(mix(h))
    row, h = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def distinct_per_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, bool)
    return row[keep], h[keep]


def ragged(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list column of ``n`` rows from values ordered by row."""
    ends = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
