"""Sets of word shingles as sorted 64-bit fingerprints, made by whole arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 20
_LONG = 64  # bytes of a word, beyond which its key is a digest: sums of powers modulo 2^64 collide for long words of a simple make
_powers: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, a random-looking number for each byte with A-Z as a-z, and which bytes are blank."""
    if not _powers:
        with np.errstate(over="ignore"):
            up = np.full(2 * _SLICE, np.uint64(_BASE))
            up[0] = 1
            down = np.full(2 * _SLICE, np.uint64(_INVERSE))
            down[0] = 1
            byte = mixed(np.arange(1, 257, dtype=np.uint64))
        byte[65:91] = byte[97:123]
        blank = np.zeros(256, dtype=bool)
        blank[[0x20, 9, 10, 11, 12, 13]] = True
        _powers.extend((np.multiply.accumulate(up), np.multiply.accumulate(down), byte, blank))
    return tuple(_powers)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for texts of 2 MB."""
    return _tables()[:2]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A fingerprint of each word of the lower-cased text (A-Z only); words are what stands between blanks."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    up, down, byte, blank = _tables()
    empty = blank[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], empty, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    out, i = [], 0
    while i < len(start):  # slices of whole words, so that a very long text needs bounded memory
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SLICE, side="right")))
        if end[j - 1] - start[i] > 2 * _SLICE - 2:  # a word longer than the tables
            out.append(np.array([digest(raw[start[i] : end[i]])], dtype=np.uint64))
            i += 1
            continue
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[raw[start[i] : end[j - 1]]] * up[: end[j - 1] - start[i]], dtype=np.uint64)))
        h = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        for k in np.flatnonzero(e - s > _LONG).tolist():
            h[k] = digest(raw[start[i + k] : end[i + k]])
        out.append(h)
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digest(word: np.ndarray) -> int:
    """The key of a long word."""
    return int.from_bytes(hashlib.blake2b(word.tobytes().lower(), digest_size=8).digest(), "little")


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingles, sorted; of fewer words than width the whole sequence; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = mixed(h + w[i : len(w) - k + 1 + i])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]
