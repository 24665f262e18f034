"""Word and shingle hashes of whole Arrow string columns with numpy.

Words are runs of bytes other than space and tab to carriage return, with A-Z
lower-cased. A word's 64-bit hash is a polynomial of its bytes, mixed with its
length. Texts are handled in pieces of about ``PIECE`` bytes; a longer text is
cut at white space, so memory does not grow with a text's length beyond eight
bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_LOW += np.uint64(1)
_BASE, _LEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, _BASE)]), dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        p = _POWERS[0]
        _POWERS[0] = np.concatenate([p, p * (p[-1] * _BASE)])
    return _POWERS[0]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _piece(b: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``b`` and the positions where they start."""
    tok = ~_SPACE[b]
    first = tok.copy()
    first[1:] &= ~tok[:-1]
    first[starts_of_texts] = tok[starts_of_texts]
    last = tok.copy()
    last[:-1] &= ~tok[1:]
    ends = starts_of_texts[starts_of_texts > 0] - 1
    last[ends] = tok[ends]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lens = np.flatnonzero(last) + 1 - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
    val = _LOW[b[tok]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(val, at) ^ (lens.astype(np.uint64) * _LEN)), starts


def word_hashes(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, words of each row) by runs of rows."""
    data, off = column_bytes(col)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        lo, hi = int(off[row]), int(off[stop])
        if hi - lo <= 2 * PIECE or stop > row + 1:
            texts = off[row:stop] - lo
            texts = texts[np.diff(off[row : stop + 1]) > 0]
            h, starts = _piece(data[lo:hi], texts)
            counts = np.bincount(np.searchsorted(off[row : stop + 1], starts + lo, "right") - 1, minlength=stop - row)
        else:  # one very long text, cut at white space
            parts, at = [], lo
            while at < hi:
                end = min(at + PIECE, hi)
                while end < hi:
                    gap = np.flatnonzero(_SPACE[data[end : end + PIECE]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end = min(end + PIECE, hi)
                parts.append(_piece(data[at:end], np.zeros(1, np.int64))[0])
                at = end
            h = np.concatenate(parts)
            counts = np.array([len(h)])
        yield row, stop, h, counts
        row = stop


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    s = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        s = mix(s * _BASE + words[i : len(words) - k + 1 + i])
    return s


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row: its word hashes and the sorted set of its shingle hashes."""
    for _, _, h, counts in word_hashes(col):
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            w = h[a:b]
            yield w, np.unique(shingle_hashes(w, k))
