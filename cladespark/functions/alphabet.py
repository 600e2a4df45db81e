"""Alphabets: characters to state codes, codes to bitmasks and back, as literal maps on the JVM side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes as bitmasks (A=1 C=2 G=4 T=8), the order of the amino acids, and the
# residues that the ambiguous letters stand for.
_DNA = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "O": 15, "X": 15, "-": 15, "?": 15}
_AMINO = "ARNDCQEGHILKMFPSTWYV"
_AMINO_PAIRS = {"B": "ND", "Z": "QE"}


@dataclass(frozen=True)
class Alphabet:
    name: str
    states: int
    #: character -> code
    codes: dict[str, int]
    #: code -> bitmask of the states it may be
    masks: dict[int, int]
    undetermined: int
    letters: str

    def encode(self, ch: Column) -> Column:
        """State code of a character column; null for a character outside the alphabet."""
        return F.create_map(*[F.lit(x) for kv in self.codes.items() for x in kv])[F.upper(ch)]

    def mask(self, code: Column) -> Column:
        return F.create_map(*[F.lit(x) for kv in self.masks.items() for x in kv])[code]

    def decode(self, code: Column) -> Column:
        back: dict[int, str] = {}
        for c, k in self.codes.items():
            back.setdefault(k, c)
        back[self.undetermined] = "-"
        return F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[code]


def _dna() -> Alphabet:
    return Alphabet("DNA", 4, dict(_DNA), {i: i for i in range(1, 16)}, 15, "ACGT")


def _binary() -> Alphabet:
    return Alphabet("BIN", 2, {"0": 1, "1": 2, "-": 3, "?": 3}, {1: 1, 2: 2, 3: 3}, 3, "01")


def _amino() -> Alphabet:
    codes = {c: i for i, c in enumerate(_AMINO)} | {"B": 20, "Z": 21} | dict.fromkeys("X-?*", 22)
    masks = {i: 1 << i for i in range(20)} | {20 + i: sum(1 << _AMINO.index(c) for c in pair) for i, pair in enumerate(_AMINO_PAIRS.values())}
    return Alphabet("AA", 20, codes, masks | {22: (1 << 20) - 1}, 22, _AMINO)


def multistate(states: int) -> Alphabet:
    """Up to 32 ordered states 0-9, A-V; `-` and `?` are undetermined."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[:states]
    codes = {c: i for i, c in enumerate(letters)} | {"-": states, "?": states}
    return Alphabet(f"MULTI{states}", states, codes, {i: 1 << i for i in range(states)} | {states: (1 << states) - 1}, states, letters)


def secondary(states: int = 16) -> Alphabet:
    """Paired sites: 16 pairs of nucleotides coded 4 * first + second; 6 and 7 states keep the stable pairs (and one mismatch class)."""
    if states == 16:
        return Alphabet("SEC16", 16, {chr(65 + i): i for i in range(16)} | {"-": 16}, {i: 1 << i for i in range(16)} | {16: 0xFFFF}, 16, "".join(chr(65 + i) for i in range(16)))
    return Alphabet(f"SEC{states}", states, {chr(65 + i): i for i in range(states)} | {"-": states}, {i: 1 << i for i in range(states)} | {states: (1 << states) - 1}, states, "".join(chr(65 + i) for i in range(states)))


DNA, BINARY, AMINO = _dna(), _binary(), _amino()
ALPHABETS = {a.name: a for a in (DNA, BINARY, AMINO)}


def encode_state(ch: Column, alphabet: str = "DNA") -> Column:
    return ALPHABETS[alphabet].encode(ch)


def decode_state(code: Column, alphabet: str = "DNA") -> Column:
    return ALPHABETS[alphabet].decode(code)
