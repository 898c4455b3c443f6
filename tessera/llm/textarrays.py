"""Whole texts as numpy arrays: byte runs, their hashes, ragged gathers.

Texts of one Arrow column share one byte buffer; the helpers work on slices of
it of about ``CHUNK`` bytes, so memory does not depend on the batch Spark sends
nor (but for a few bytes a word) on the length of one text.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21       # bytes of text handled at a time
BLOCK = 1 << 19       # bytes hashed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are reused, and what one keeps another stage lacks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def byte_table(fold_case: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; ``fold_case`` maps A-Z to a-z."""
    b = np.arange(256)
    if fold_case:
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
    return mix((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
LETTERS = np.zeros(256, bool)      # ASCII letters and every byte of a non-ASCII character
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def chunks(column, size: int = CHUNK):
    """Yield (first row, end row, bytes, offsets from 0) over slices of whole texts."""
    buf, off = texts(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def runs(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]`` that stay in one text: (starts, ends, text index)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | cut[1:-1]
    last[:-1] &= ~m[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


PLACES = 64           # places of a word whose values are kept in a table


@lru_cache(maxsize=2)
def _place_table(folded: bool) -> np.ndarray:
    """A 64-bit value for each place below ``PLACES`` and byte, one row of 256 a place."""
    place = np.arange(PLACES, dtype=np.uint64)
    return mix(byte_table(folded)[None, :] ^ mix((place + np.uint64(1)) * _BASE)[:, None]).ravel()


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, the same wherever the run stands.

    Every (byte, place in the run) has a value of its own, mixed from both, and a
    run's hash is their sum: it has no algebra in the places, so words made of
    swapped or mirrored parts don't meet as they do in a polynomial.
    """
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    table = _place_table(bool(values[65] == values[97]))
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK)))
        size = ends[i:j] - starts[i:j]
        place = ragged(np.zeros(j - i, np.int64), size)
        byte = buf[ragged(starts[i:j], size)]
        if size.max(initial=0) <= PLACES:
            each = table[(place << 8) | byte]
        else:
            near = place < PLACES
            each = np.empty(len(place), np.uint64)
            each[near] = table[(place[near] << 8) | byte[near]]
            far = ~near
            each[far] = mix(values[byte[far]] ^ mix((place[far].astype(np.uint64) + np.uint64(1)) * _BASE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        cut = np.concatenate([[0], np.cumsum(size)])
        out[i:j] = mix(sums[cut[1:]] - sums[cut[:-1]] + size.astype(np.uint64) * _M2)
        i = j
    return out


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offset, offset+1, ... for each (offset, length), one after the other."""
    total = int(lengths.sum())
    shift = offsets - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in text order and their text index; a text of
    fewer words gives its whole sequence as one shingle, one without words none."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    per = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(n_docs), per)
    at = ragged(first, per)
    h = np.full(len(at), 0x5851F42D4C957F2D, np.uint64)
    for i in range(k):
        ok = i < count[owner]
        w = words[np.minimum(at + i, len(words) - 1)] if len(words) else words
        h = np.where(ok, mix(h * _BASE + w), h)
    return h, owner
