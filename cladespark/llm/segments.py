"""Texts cut, batch-wise, where no piece of a model can span: what lies between two cuts is encoded by itself.

Two neighbouring characters that stand next to each other in no piece never get into one piece. The model's pieces give a table
of such pairs for the characters below LIMIT, and of whether any higher character may stand beside them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .piece_model import SPACE, PieceModel

LIMIT = 0x250


def _column(char: str) -> int:
    return min(ord(" " if char == SPACE else char), LIMIT)


def cut_table(model: PieceModel) -> np.ndarray:
    """[a, b] whether texts may be cut between the characters a and b; LIMIT stands for all from there on."""
    out = np.ones((LIMIT + 1, LIMIT + 1), bool)
    for piece in model.ids:
        for a, b in zip(piece[:-1], piece[1:], strict=True):
            out[_column(a), _column(b)] = False
    return out


class Segments:
    def __init__(self, model: PieceModel):
        self.prefix, self.table = " " if model.dummy_prefix else "", cut_table(model).ravel()

    def of(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(data, at, counts): the segments data[at[i] : at[i + 1]] of all texts, each text with its prefix space, and
        how many each text has. SPACE is a space, as in the model's own reading."""
        joined = "".join([self.prefix + t if t else "" for t in texts]).replace(SPACE, " ")
        if not joined:
            return b"", np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low = np.minimum(points, LIMIT).astype(np.int32)
        cut = np.empty(len(points), bool)
        cut[0] = True
        cut[1:] = self.table[low[:-1] * np.int32(LIMIT + 1) + low[1:]]
        sizes = np.array([len(t) + len(self.prefix) if t else 0 for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        cut[firsts[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        data = joined.encode()
        if len(data) == len(points):
            at = starts
        else:
            width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
            at = (np.cumsum(width) - width)[starts]
        bounds = np.searchsorted(starts, np.append(firsts, len(points)))
        return data, np.append(at, len(data)), np.diff(bounds)


@lru_cache(maxsize=2)
def segments(model_path: str) -> Segments:
    from . import piece_model

    return Segments(piece_model.load(model_path))
