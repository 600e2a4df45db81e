"""Models of paired sites: which changes between pairs of nucleotides share a rate, by rule.

Stable pairs are AU, CG, GC, GU, UA and UG; the seven-state form has all mismatches as one more state, the sixteen-state
form has every pair. Changes are told apart by what they do: two transitions at once (0), one transition that keeps the
pair stable (1), a change of both bases otherwise (2), a change between a stable pair and a mismatch (3), between two
mismatches (4). A group of -1 is a change that can't happen.
"""

from __future__ import annotations

from collections.abc import Sequence

from .model import Model

BASES = "ACGU"
STABLE = ("AU", "CG", "GC", "GU", "UA", "UG")
MISMATCH = "--"
ALL_PAIRS = tuple(a + b for a in BASES for b in BASES)


# The rate groups of S7C over the upper triangle; -1 is a change that can't happen.
S7C = (-1, -1, 0, -1, -1, 1, -1, -1, -1, 2, 3, 4, -1, -1, 5, -1, -1, 6, 7, 8, 9)


def pairs(states: int) -> tuple[str, ...]:
    return {6: STABLE, 7: (*STABLE, MISMATCH), 16: ALL_PAIRS}[states]


def _transition(a: str, b: str) -> bool:
    return {a, b} in ({"A", "G"}, {"C", "U"})


def change(x: str, y: str) -> int:
    """The group of a change between two pairs."""
    if MISMATCH in (x, y):
        return 3
    moved = [(a, b) for a, b in zip(x, y, strict=True) if a != b]
    if x in STABLE and y in STABLE:
        if all(_transition(a, b) for a, b in moved):
            return 0 if len(moved) == 2 else 1
        return 2
    return -1 if len(moved) == 2 else 3 if x in STABLE or y in STABLE else 4


def symmetry(name: str) -> tuple[list[int], list[int]]:
    """(group of each upper-triangle rate, group of each frequency) of S6A-S6E, S7A-S7F, S16, S16A and S16B."""
    family, kind = (name, "") if name == "S16" else (name[:-1], name[-1])
    states = pairs(int(family[1:]))
    groups = [change(x, y) for i, x in enumerate(states) for y in states[i + 1 :]]
    free = list(range(len(states)))
    mirrored = [min(i, states.index(x[::-1])) if x[::-1] in states else i for i, x in enumerate(states)]
    mirrored = [sorted(set(mirrored)).index(m) for m in mirrored]
    table = {
        "S6A": (None, free), "S6B": (groups, free), "S6C": (groups, mirrored), "S6D": ([-1 if g == 0 else g for g in groups], mirrored), "S6E": ([-1 if g == 0 else g for g in groups], free),
        "S7A": (None, free), "S7B": (None, mirrored), "S7C": (list(S7C), free), "S7D": (groups, free), "S7E": ([g if g in (1, 3) else -1 for g in groups], free), "S7F": (groups, mirrored),
        "S16": (None, free), "S16A": (groups, free), "S16B": ([min(g, 0) for g in groups], free),
    }
    if name not in table:
        raise ValueError(f"unknown paired-site model {name}")
    found, freqs = table[name]
    if found is None:  # every change has a rate of its own
        found = list(range(len(groups)))
    labels = sorted({g for g in found if g >= 0})
    return [labels.index(g) if g >= 0 else -1 for g in found], freqs


def paired_model(name: str, values: Sequence[float], freqs: Sequence[float]) -> Model:
    """A model from one rate per group and one frequency per state (equal within a frequency group)."""
    groups, kinds = symmetry(name)
    if len(values) != max(groups) + 1:
        raise ValueError(f"{max(groups) + 1} rates are expected")
    if any(abs(freqs[i] - freqs[j]) > 1e-12 for i in range(len(kinds)) for j in range(i) if kinds[i] == kinds[j]):
        raise ValueError("frequencies of one group must be equal")
    return Model(tuple(freqs), tuple(0.0 if g < 0 else float(values[g]) for g in groups), name=name)
