"""Vectorised word and shingle hashing straight on the bytes of Arrow string columns.

A batch's texts are one byte buffer with offsets.  Word borders come from a byte class table, a
word's 64-bit hash from prefix sums of a polynomial over randomly drawn byte values, so no Python
object is made per word or per text.  Work runs in slices of about ``SLICE`` bytes (a longer text
is a slice of its own), which bounds the temporary arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WEIGHTS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_bytes = np.arange(256)
LOWER = _bytes.astype(np.uint8)
LOWER[65:91] += 32
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = ~np.isin(_bytes, [32, 9, 10, 11, 12, 13])
#: Digits, letters and every byte of a character beyond ASCII (after lower-casing).
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | ((_bytes >= 65) & (_bytes <= 90)) | (_bytes >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_LOWERED = _VALUES[LOWER]
#: Bits of a shingle's hash; the rest of 64 holds the text's number within a slice.
HASH_BITS = 50
ROWS = 1 << (64 - HASH_BITS)
#: Beyond so many words a text's shingles are counted by 64 bits.
MANY_WORDS = 1 << 14

_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of ``rows`` consecutive texts.  Text r has words ``first[r]:first[r + 1]``."""

    row: int
    rows: int
    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray  # byte positions within the slice
    end: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, body


def hash_words(data: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, begins and ends of the words in ``data``; no word crosses a position in ``starts``.
    A long text is hashed in pieces that end between words, so the work space is that of a piece."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 2 * SLICE:
        parts, at = [], 0
        while at < n:
            stop = _between_words(data, at + SLICE, keep)
            own = starts[(starts > at) & (starts < stop)] - at
            h, b, e = _hash_piece(data[at:stop], own, keep)
            parts.append((h, b + at, e + at))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _hash_piece(data, starts, keep)


def _between_words(data: np.ndarray, at: int, keep: np.ndarray) -> int:
    """The first place from ``at`` on where a byte outside words stands, or the end."""
    while at < len(data):
        outside = np.flatnonzero(~keep[data[at : at + SLICE]])
        if len(outside):
            return at + int(outside[0])
        at += SLICE
    return len(data)


def _hash_piece(data: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = keep[data]
    borders = starts[(starts > 0) & (starts < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[borders] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    total = np.cumsum(_LOWERED[data] * up[:n], dtype=np.uint64)
    left = np.where(begin > 0, total[begin - 1], np.uint64(0))
    return mix((total[end - 1] - left) * down[begin]), begin, end


def words_of(column: pa.Array | pa.ChunkedArray, keep: np.ndarray = NOT_BLANK) -> Iterator[Words]:
    """The words of an Arrow string column (null: empty text), slice by slice, rows in order."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        at, body = _buffers(chunk)
        row, n = 0, len(chunk)
        while row < n:
            stop = int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1
            stop = min(n, row + ROWS, max(stop, row + 1))
            data = body[at[row] : at[stop]]
            starts = at[row:stop] - at[row]
            hashes, begin, end = hash_words(data, starts, keep)
            first = np.append(np.searchsorted(begin, starts), len(begin))
            yield Words(row, stop - row, hashes, first, begin, end, data)
            row = stop


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    h, n = words.hashes, len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += h[j : n - size + 1 + j] * _WEIGHTS[j % 64]
    last = np.repeat(words.first[1:], words.counts)[: n - size + 1]
    return mix(total + np.uint64(size)), np.arange(size, n + 1) <= last


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole word sequence, equal to window_hashes of that size."""
    weights = _WEIGHTS[np.arange(len(hashes)) % 64]
    return mix(np.array([(hashes * weights).sum(dtype=np.uint64) + np.uint64(len(hashes))], dtype=np.uint64))[0]


def distinct_shingles(words: Words, size: int, offsets: np.ndarray) -> np.ndarray:
    """Sizes of the shingle sets whose offsets are given.  In a text of very many words two shingles may
    share their HASH_BITS; there the 64-bit hashes are counted."""
    out = np.diff(offsets).astype(np.int64)
    for r in np.flatnonzero(words.counts > MANY_WORDS).tolist():
        a, b = words.first[r], words.first[r + 1]
        own = Words(0, 1, words.hashes[a:b], np.array([0, b - a]), words.begin[a:b], words.end[a:b], words.data)
        out[r] = len(np.unique(window_hashes(own, size)[0]))
    return out


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``size``-word shingles of every text, concatenated, and their offsets.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    Shingles are HASH_BITS wide, so that a text's number and a shingle sort as one integer.
    """
    hashes, whole = window_hashes(words, size)
    counts = words.counts
    own = np.repeat(np.arange(words.rows, dtype=np.uint64) << np.uint64(HASH_BITS), counts)
    value = (hashes >> np.uint64(64 - HASH_BITS) | own[: len(hashes)])[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([sequence_hash(words.hashes[words.first[r] : words.first[r + 1]]) for r in short], dtype=np.uint64)
        value = np.concatenate([value, extra >> np.uint64(64 - HASH_BITS) | short.astype(np.uint64) << np.uint64(HASH_BITS)])
    value.sort()
    if len(value):
        value = value[np.append(True, value[1:] != value[:-1])]
    offsets = np.append(np.searchsorted(value, np.arange(words.rows, dtype=np.uint64) << np.uint64(HASH_BITS)), len(value))
    return value & np.uint64((1 << HASH_BITS) - 1), offsets
