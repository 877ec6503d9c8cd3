"""Word shingles of texts as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORDS = 5
_PIECE = 1 << 18
_SPACES = {0x20, *range(0x09, 0x0E)}
_FOLD = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([0 if b == 32 else 1 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], np.int8)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_STEP = mixed(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, _PIECE + 1), np.uint64(base & _MASK))
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _hash_words(data: np.ndarray) -> np.ndarray:
    """Hash of every run of bytes other than spaces."""
    word = data != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return hash_runs(data, edges[0::2], edges[1::2])


def _hash_terms(data: np.ndarray) -> np.ndarray:
    """Hash of every run of letters and digits, and of every run of other signs."""
    kind = _KIND[data]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(data)]])
    start = edges[:-1][kind[edges[:-1]] > 0] if len(data) else edges[:0]
    return hash_runs(data, start, edges[np.searchsorted(edges, start) + 1])


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words after A-Z was lowered."""
    return _in_pieces(text, _hash_words)


def term_hashes(text: str) -> np.ndarray:
    """Hashes of a text's terms after A-Z was lowered: runs of letters and digits, runs of other signs.

    Characters beyond ASCII count as letters.
    """
    return _in_pieces(text, _hash_terms)


def _in_pieces(text: str, hashes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Hashes of a text in pieces of bounded size, which are cut between words."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    if len(folded) <= _PIECE:
        return hashes(np.frombuffer(folded, np.uint8))
    out, at = [], 0
    while at < len(folded):
        end = min(len(folded), at + _PIECE)
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            if cut <= at:  # one word longer than a piece
                cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut + 1
        out.append(hashes(np.frombuffer(folded, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``WORDS`` words; fewer words are one shingle."""
    if not text:
        return np.zeros(0, np.uint64)
    own = word_hashes(text)
    n = len(own)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, WORDS)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += own[k : n - size + 1 + k] * _STEP[k]
    return np.unique(mixed(total + np.uint64(size)))
