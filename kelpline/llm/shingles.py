"""Words and word shingles as 64-bit hashes, by numpy over many texts at once.

Words are stretches without space or controls 9 to 13, A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES, SPACES

#: Texts go through together until they have so many bytes; a longer one goes alone.
BLOCK = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES.encode())] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Odd multipliers for the places of a shingle.
PLACES = np.random.default_rng(20240102).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes (uint64) of its words in order."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK):
            size += len(texts[b]) + 1
            b += 1
        out += _block(texts[a:b])
        a = b
    return out


def _block(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(texts).translate(LOWER_BYTES) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.searchsorted(starts, 1 + np.cumsum([0] + [len(t) + 1 for t in texts]))
    return [words[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole if there are fewer, but some."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n] * PLACES[0]
    for j in range(1, k):
        h = h + words[j : j + n] * PLACES[j]
    return mix(h)
