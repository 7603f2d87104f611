"""Word shingles of UTF-8 texts as 64-bit hashes, computed over whole columns at once.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case. A word's hash is a polynomial over its bytes,
taken from running sums; a shingle's hash is a polynomial over the hashes of its words.
"""

from __future__ import annotations

import numpy as np

from wayfold.llm.common import mix64

#: Bytes hashed at a time; longer texts are cut at white space.
BLOCK = 1 << 20
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0x9FB21C651E98DF25)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(max(n, BLOCK + 1), base, np.uint64)
            row[0] = 1
            _POWERS.append(np.multiply.accumulate(row))
    return _POWERS[0], _POWERS[1]


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Running sums: ``(sums[b] - sums[a]) * inverse_powers(n)[a]`` is a hash of the bytes from a to b."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    return _powers(n + 1)[1]


def _blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    blank = _blanks(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:n]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    sums = hash_sums(data)
    words = mix64((sums[ends] - sums[starts]) * inverse_powers(n)[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the row it stands in."""
    if len(data) <= 4 * BLOCK:
        return _hashed(data, offs)
    words, rows = [], []
    for row, (at, end) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        while at < end:
            to = min(at + BLOCK, end)
            if to < end:
                space = np.flatnonzero(_blanks(data[to : min(to + BLOCK, end)]))
                while not len(space) and to < end:
                    to = min(to + BLOCK, end)
                    space = np.flatnonzero(_blanks(data[to : min(to + BLOCK, end)]))
                to = to + int(space[0]) if len(space) else end
            found, _ = _hashed(data[at:to], np.array([0, to - at]))
            words.append(found)
            rows.append(np.full(len(found), row))
            at = to
    return np.concatenate(words), np.concatenate(rows)


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows in order, and the n + 1 bounds of each row's.

    A row with fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    words, rows = word_hashes(data, offs)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    own = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(own)])
    row = np.repeat(np.arange(n), own)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    hashed = np.zeros(len(at), np.uint64)
    for k in range(size):
        word = padded[at + k]
        short = count[row] <= k
        if short.any():
            word = np.where(short, np.uint64(0), word)
        hashed = hashed * _STEP + word
    return mix64(hashed + np.uint64(1)), bounds


def set_mark(tokens: np.ndarray) -> int:
    """A signed 64-bit mark of a set of distinct tokens."""
    total = int(np.sum(mix64(tokens * np.uint64(3) + np.uint64(7)), dtype=np.uint64)) if len(tokens) else 0
    mixed = int(mix64(np.array([total + len(tokens) & (1 << 64) - 1], np.uint64))[0])
    return mixed - (1 << 64) if mixed >> 63 else mixed
