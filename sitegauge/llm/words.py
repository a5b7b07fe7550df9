"""Vectorised word splitting over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, within one
text.  Words are returned as 64-bit hashes of their bytes (A-Z lower-cased on
request) with byte positions, computed with numpy over the column's own value
buffer, so no Python object is made for a word.  Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.arange(256, dtype=np.uint8)
BLANK[[i for i in range(128) if not chr(i).isalnum()]] = 32



def fold_case(data: np.ndarray) -> np.ndarray:
    """Capitals U+00C0 to U+00DE made small, in UTF-8."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    data = data.copy()
    data[at] += 32
    return data


CHUNK = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 4096, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _MULT), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which ascend and don't overlap."""
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo, hi = starts[a], ends[b - 1]
        up, down = _pow(hi - lo)
        part = data[lo:hi]
        values = (LOWER[part] if lower else part).astype(np.uint64)
        values += np.uint64(1)
        values *= up[: hi - lo]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = (total[e] - total[s]) * down[np.minimum(s, len(down) - 1)]
        a = b
    return mix(hashes)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """-> (hash, start, end, text number) of each word in order."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return span_hashes(data, starts, ends, lower), starts, ends, text


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs within each text, and the n_texts + 1 bounds.

    A text with 1 to k-1 words gives one hash, of its whole sequence."""
    count = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    odd = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(k)]
    n = len(hashes)
    if n >= k:
        runs = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            runs += mix(hashes[i : n - k + 1 + i] * odd[i] + np.uint64(i))
        runs = mix(runs)
    else:
        runs = np.zeros(0, np.uint64)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(bounds[-1], np.uint64)
    owner = np.repeat(np.arange(n_texts), made)
    pos = np.arange(bounds[-1]) - bounds[owner] + first[owner]
    full = count[owner] >= k
    out[full] = runs[pos[full]]
    for t in np.flatnonzero((count > 0) & (count < k)):
        h = np.full(1, count[t], np.uint64)
        for i in range(first[t], first[t + 1]):
            h = mix(h * _MULT + hashes[i : i + 1])
        out[bounds[t]] = h[0]
    return out, bounds
