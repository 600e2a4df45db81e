"""Reads a SentencePiece .model file: its pieces, and the flags of its normaliser."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol message."""
    i, n = 0, len(data)

    def number() -> int:
        nonlocal i
        shift = out = 0
        while True:
            out |= (data[i] & 127) << shift
            i += 1
            if data[i - 1] < 128:
                return out
            shift += 7

    while i < n:
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[i : i + size]
            i += size


class PieceModel:
    """pieces[i] is the string of id i (spaces as SPACE), scores[i] and kinds[i] likewise."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, byte_fallback: bool = False, dummy_prefix: bool = True):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.bpe, self.byte_fallback, self.dummy_prefix = bpe, byte_fallback, dummy_prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER)}
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        if any(k in (USER, UNUSED) for k in kinds):
            raise ValueError("user-defined and unused pieces aren't handled")
        inner = {c for p in self.ids for c in p}
        #: A line feed that no piece holds merges with nothing.
        self.line_breaks = "\n" not in inner
        #: No piece has a space after another character, so nothing merges over the start of a word.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, scores, kinds, flags = [], [], [], {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b"").decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, NORMAL))
            elif number in (2, 3):
                flags[number] = dict(_fields(value))
        trainer, normal = flags.get(2, {}), flags.get(3, {})
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or trainer.get(3, 1) not in (1, 2):
            raise ValueError("only identity normalisation with escaped, kept spaces is handled")
        return cls(pieces, scores, kinds, trainer.get(3, 1) == 2, bool(trainer.get(35)), bool(normal.get(3, 1)))

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_fallback else [self.unknown]


class Consistency:
    """Whether pieces stand next to each other in a merge segmentation.

    Merging takes the adjacent pair whose joined string has the best score, leftmost first. A sequence of pieces
    is the result for its text if and only if each piece results for itself and each adjacent pair for itself:
    the first merge over a boundary in the whole text would also happen in the pair alone."""

    def __init__(self, model: PieceModel):
        self.model, self.pairs, self.own = model, {}, {}

    def merged(self, text: str) -> list[str]:
        ids, scores, parts = self.model.ids, self.model.scores, list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: int) -> bool:
        found = self.own.get(piece)
        if found is None:
            found = self.own[piece] = self.merged(self.model.pieces[piece]) == [self.model.pieces[piece]]
        return found

    def judge(self, left: int, right: int) -> bool:
        """left: -1 where nothing that merges stands before."""
        if left < 0:
            return self.whole(right)
        a, b = self.model.pieces[left], self.model.pieces[right]
        return self.whole(right) and self.merged(a + b) == [a, b]

    def fits(self, left: int, right: int) -> bool:
        """judge, with a memory of pairs."""
        if left < 0:
            return self.whole(right)
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 600_000:  # bounded memory; what is needed comes back soon
                self.pairs.clear()
            found = self.pairs[key] = self.judge(left, right)
        return found


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel.load(path)
