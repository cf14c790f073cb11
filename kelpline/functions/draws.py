"""Draws by chance from MD5 of a text and a number, many at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers at a time, so that what is worked on stays in a core's cache, and numbers whose digits are kept.
_PART, TILE = 1 << 15, 1 << 20
#: Fewer numbers than these are done one by one.
_FEW = 1500


def _first_word(words: list, width: int) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of so many words, each one number for all or an array."""
    state = [np.full(width, x, np.uint32) for x in _START]
    t, u = np.empty(width, np.uint32), np.empty(width, np.uint32)
    for at in range(0, len(words), 16):
        last = at + 16 == len(words)
        a, b, c, d = (s.copy() for s in state)
        for i in range(61 if last else 64):  # three steps more only move the first word on
            if i < 16:
                np.bitwise_xor(c, d, out=t)
                t &= b
                t ^= d
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                t &= d
                t ^= c
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=t)
                t ^= d
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=t)
                t |= b
                t ^= c
                g = 7 * i % 16
            t += a
            word, turn = words[at + g], _TURNS[i // 16][i % 4]
            if isinstance(word, int):
                t += np.uint32((_ADDED[i] + word) & 0xFFFFFFFF)
            else:
                t += np.uint32(_ADDED[i])
                t += word
            np.right_shift(t, np.uint32(32 - turn), out=u)
            np.left_shift(t, np.uint32(turn), out=t)
            t |= u
            t += b
            a, b, c, d, t = d, t, b, c, a
        if last:
            return state[0] + b
        for s, x in zip(state, (a, b, c, d)):
            s += x
    raise ValueError("a message has a block at least")


def _digit_words(first: int, stop: int, digits: int, shift: int) -> np.ndarray:
    """Numbers' decimal digits as the words of a message that has shift bytes before them in their first word."""
    n = np.arange(first, stop, dtype=np.uint32 if stop <= 2**32 else np.uint64)
    out = np.zeros(((shift + digits + 3) // 4, len(n)), np.uint32)
    for j in range(digits - 1, -1, -1):
        rest = n // 10
        out[(shift + j) // 4] |= (n - rest * 10 + 48).astype(np.uint32) << np.uint32(8 * ((shift + j) % 4))
        n = rest
    return out


def tiles(n: int) -> Iterator[tuple[int, int]]:
    """1 to n in stretches of TILE at most, whose numbers have as many digits."""
    first = 1
    while first <= n:
        stop = min(n + 1, 10 ** len(str(first)), first + TILE)
        yield first, stop
        first = stop


class Draws:
    """Of the numbers of a tile (first to stop - 1)."""

    def __init__(self, first: int, stop: int) -> None:
        self.first, self.stop, self.digits = first, stop, len(str(first))
        self.words: dict[int, np.ndarray] = {}

    def heads(self, text: bytes) -> np.ndarray:
        """For each number: the first 32 bits of the MD5 of text with the number's digits after it."""
        if self.stop - self.first < _FEW:
            begun = hashlib.md5(text)
            heads = []
            for n in range(self.first, self.stop):
                one = begun.copy()
                one.update(b"%d" % n)
                heads.append(one.digest()[:4])
            return np.frombuffer(b"".join(heads), ">u4").astype(np.uint32)
        size, shift = len(text) + self.digits, len(text) % 4
        if shift not in self.words:
            self.words[shift] = _digit_words(self.first, self.stop, self.digits, shift)
        filled = text + bytes(self.digits) + b"\x80"
        filled += bytes(-(len(filled) + 8) % 64) + (8 * size).to_bytes(8, "little")
        fixed, own, begin = np.frombuffer(filled, "<u4").tolist(), self.words[shift], len(text) // 4
        out = np.empty(self.stop - self.first, np.uint32)
        for at in range(0, len(out), _PART):
            words = list(fixed)
            for k, row in enumerate(own[:, at : at + _PART]):
                words[begin + k] = row | np.uint32(fixed[begin + k])
            out[at : at + _PART] = _first_word(words, min(_PART, len(out) - at))
        return out.byteswap()
