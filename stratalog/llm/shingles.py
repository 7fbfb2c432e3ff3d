"""Word shingles of whole texts, as 64-bit hashes, vectorised over a column of texts.

Words are runs of bytes other than space and 0x09-0x0D, after A-Z are lower-cased.
A text's shingles are its runs of `width` consecutive words; a text with fewer words
has its whole sequence as its only shingle; one without words has none.
Hashes are polynomial over a random 64-bit table and finalised, so two different
shingles of a pair of texts agree with a chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _odd(11, 256)
for _upper in range(65, 91):
    _BYTE[_upper] = _BYTE[_upper + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _odd(12, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse for i < n, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to each end); `data` holds the texts' bytes,
    text i ending before ends[i]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashed = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    return hashed, np.searchsorted(begin, ends)


def shingles(data: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' sorted distinct shingle hashes, one text after another; their number per text)."""
    w, upto = words(data, ends)
    n = np.diff(upto, prepend=0)
    slots = np.where(n < width, np.minimum(n, 1), n - width + 1)
    begin = np.cumsum(slots) - slots
    at = np.arange(int(slots.sum())) - np.repeat(begin - (upto - n), slots)
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h += w[np.minimum(at + j, len(w) - 1)] * _PLACE[j]
    short = np.flatnonzero((n > 0) & (n < width))
    own = n[short].astype(np.uint64)
    for j in range(width - 1):
        own += np.where(j < n[short], w[np.minimum(upto[short] - n[short] + j, max(len(w) - 1, 0))] * _PLACE[width + j], np.uint64(0)) if len(w) else np.uint64(0)
    h[begin[short]] = own
    h = mix(h)
    for a, size in zip(begin.tolist(), slots.tolist()):
        if size > 1:
            h[a : a + size].sort()
    if len(h):
        doc = np.repeat(np.arange(len(ends)), slots)
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[keep], np.bincount(doc[keep], minlength=len(ends))
    return h, np.zeros(len(ends), np.int64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of an Arrow string column; null as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def pieces(column, most: int = 2_000_000):
    """Slices of a string column, of about `most` bytes each (a longer text is one by itself): (first row, bytes, ends)."""
    data, ends = text_bytes(column)
    i = 0
    while i < len(ends):
        at = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, at + most, "right")))
        yield i, data[at : int(ends[j - 1])], ends[i:j] - at
        i = j
