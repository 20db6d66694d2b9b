"""Sets of hashed word shingles, computed with numpy over the bytes of a text.

Words are runs of bytes other than blanks and control spaces (0x20, 0x09-0x0D), with A-Z as a-z. A
shingle is five words in a row; a text of one to four words has one shingle, all of its words. Hashes have
64 bits and depend on the words alone.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_CHUNK = 1 << 20
_FACTOR = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(2024).integers(0, 1 << 64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64, at least n of them."""
    size = 1 << max(14, (n - 1).bit_length())
    if size not in _POWERS:
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            pair.append(np.cumprod(row, dtype=np.uint64))
        if size > _CHUNK:
            return pair[0], pair[1]
        _POWERS[size] = (pair[0], pair[1])
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunk_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    power, inverse = powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of every word, in order; long texts are read in pieces that end between words."""
    if len(raw) <= _CHUNK:
        return _chunk_hashes(raw) if raw else np.empty(0, np.uint64)
    parts, begin = [], 0
    while begin < len(raw):
        end = min(len(raw), begin + _CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_chunk_hashes(raw[begin:end]))
        begin = end
    return np.concatenate(parts)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Distinct shingles in the order of their hashes."""
    h = word_hashes(raw) if raw else np.empty(0, np.uint64)
    if not len(h):
        return h
    if len(h) < WORDS:
        s = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            s = mixed(s * _FACTOR + h[i : i + 1])
        return s
    s = h[: len(h) - WORDS + 1]
    for i in range(1, WORDS):
        s = mixed(s * _FACTOR + h[i : len(h) - WORDS + 1 + i])
    return np.unique(s)


def set_hash(shingles: np.ndarray) -> int:
    """One number for a set, as a signed 64-bit integer."""
    total = np.array([mixed(shingles ^ _FACTOR).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)
    return int(mixed(total).view(np.int64)[0])
