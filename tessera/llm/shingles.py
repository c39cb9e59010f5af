"""Word shingles as 64-bit hashes, a whole text at a time in array operations."""

from __future__ import annotations

import numpy as np

WORDS = 5
_STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _U(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs of bytes other than space and 9 to 13) of a text, A-Z lower-cased, in order."""
    data, found, start = text.translate(_LOWER), [], 0
    while start < len(data):
        stop = start + _STEP
        while stop < len(data) and not _SPACE[data[stop]]:  # steps end between words
            stop += 1
        b = np.frombuffer(data[start:stop], np.uint8)
        start = stop
        gap = _SPACE[b]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(first):
            continue
        last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]]))
        size = last - first + 1
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b)))) if not first[0] else None
        if place is None:
            place = np.arange(len(b) - first[0]) - np.repeat(first - first[0], np.diff(np.append(first, len(b))))
            b, gap, first = b[first[0] :], gap[first[0] :], first - first[0]
        power = _powers(int(size.max()))
        value = (b.astype(np.uint64) + _U(1)) * power[np.where(gap, 0, place)]
        value[gap] = 0
        found.append(mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, ascending; a text of fewer words is one shingle, one of none has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, _U(k * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _PLACES[i]
    return np.unique(mix64(out))
