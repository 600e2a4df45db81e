"""Vectorised word and window hashes over UTF-8 bytes; words are runs without the bytes 0x20 and 0x09-0x0D."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _WORD1, _WORD2 = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, len(self.up) * 3 // 2)
            for name, x in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(size, x, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _W1, _W2 = _Powers(_BASE), _Powers(_WORD1), _Powers(_WORD2)
_TABLE = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 64, 256, dtype=_U, endpoint=False)
_TABLE2, _BYTES2 = np.random.Generator(np.random.PCG64(19790131)).integers(0, 1 << 64, 256, dtype=_U, endpoint=False), _Powers(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the texts raw[at[i]:at[i+1]], and the number of words before each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word (second: another one, by another table and base). A long text is taken in blocks of words, so
    memory stays bounded."""
    table, powers = (_TABLE2, _BYTES2) if second else (_TABLE, _BYTES)
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = powers.get(b - a + 1)
        total = np.zeros(b - a + 1, _U)
        np.cumsum(table[raw[a:b]] * up[:-1], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0x9FB21C651E98DF25))
        lo = hi
    return out


def _rolled(words: np.ndarray, size: int, powers: _Powers) -> np.ndarray:
    n = len(words)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[size:] - total[: n + 1 - size]) * down[: n + 1 - size])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of words[i:i+size] for each i; a window may span texts, which the caller rules out."""
    return _rolled(words, size, _W1) if len(words) >= size else np.zeros(0, _U)


def second_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As window_hashes by another base; words: their second hashes."""
    return _rolled(words, size, _W2) if len(words) >= size else np.zeros(0, _U)
