"""Distinct short strings of a batch, and a per-process memory of what they encode to, bounded in entries and in bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: A longer key (in bytes) is encoded each time it is met in a batch and never kept.
LONG = 256


class _Index(dict):
    def __init__(self):
        self.new: list = []

    def __missing__(self, key: bytes) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at


def distinct(data: bytes, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings among data[at[i] : at[i + 1]], and which of them each one is."""
    kind, number = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    offsets = pa.py_buffer(np.ascontiguousarray(at, number))
    coded = pa.Array.from_buffers(kind, len(at) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    _, ends, held = coded.dictionary.buffers()
    keys, ends = held.to_pybytes() if held else b"", np.frombuffer(ends, number)[: len(coded.dictionary) + 1].tolist()
    return [keys[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], coded.indices.to_numpy()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for each i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Memory:
    """encode(keys) gives the numbers of all keys one after the other and how many each has. What it gives is kept for at
    most `most` keys and about `most_bytes` of keys and numbers (beyond that the memory starts anew), and a batch adds at most what
    it holds itself. Keys over LONG bytes aren't kept."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 500_000, most_bytes: int = 48 << 20, dtype: type = np.int32):
        self.encode, self.most, self.most_bytes, self.dtype = encode, most, most_bytes, dtype
        self.clear()

    def clear(self) -> None:
        self.index, self.size, self.used, self.held = _Index(), np.zeros(1 << 12, np.int32), 0, 0
        self.start, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype)

    def _learn(self) -> None:
        keys, self.index.new = self.index.new, []
        if not keys:
            return
        got, sizes = self.encode(keys)
        n, total = len(self.index), len(got)
        while len(self.size) < n:
            self.size, self.start = np.concatenate([self.size, np.zeros_like(self.size)]), np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        first = n - len(keys)
        self.size[first:n] = sizes
        self.start[first:n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = got
        self.used += total
        self.held += sum(map(len, keys)) + total * self.flat.itemsize

    def of(self, keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes): the numbers of keys[i] are flat[starts[i] : starts[i] + sizes[i]]. keys are distinct."""
        if len(self.index) > self.most or self.held > self.most_bytes:
            self.clear()
        long = [i for i, k in enumerate(keys) if len(k) > LONG]
        if not long:
            places = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
            self._learn()
            return self.flat, self.start[places], self.size[places].astype(np.int64)
        flat, starts, sizes = self.of([k for k in keys if len(k) <= LONG])
        got, n = self.encode([keys[i] for i in long])
        every_start, every_size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        kept = np.ones(len(keys), bool)
        kept[long] = False
        every_start[kept], every_size[kept] = starts, sizes
        every_start[long], every_size[long] = self.used + np.cumsum(n) - n, n
        return np.concatenate([flat[: self.used], np.asarray(got, self.dtype)]), every_start, every_size

    def joined(self, keys: Sequence[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of keys[which[i]] for each i, one after the other, and how many each has."""
        flat, starts, sizes = self.of(keys)
        return gather(flat, starts[which], sizes[which]), sizes[which]


def per_text(sizes: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    """Sums of sizes over runs of counts[i] entries."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(np.asarray(counts, np.int64))
    return total[ends] - total[ends - np.asarray(counts, np.int64)]
