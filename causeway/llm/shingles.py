"""Sets of word shingles: exact ones, and their hashes in blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: list[np.ndarray] = []
#: Bytes of texts hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_set(text: str, size: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct shingles; of a shorter text its words; of none, nothing."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def _block(texts: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _base_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, limits)
    n = max(0, len(words) - size + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(size):
        joined += words[k : k + n] * _FACTORS[k]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_hashes(texts: list[str], size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the ascending 64-bit hashes of its shingles (up to five words)."""
    held: list[bytes] = []
    total = 0
    for t in texts:
        b = t.encode().lower()
        if held and total + len(b) > BLOCK_BYTES:
            yield from _block(held, size)
            held, total = [], 0
        held.append(b)
        total += len(b) + 1
    if held:
        yield from _block(held, size)
