"""Parsers and writers of alignment texts and partition files; pure functions over text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence


def parse_phylip(text: str) -> list[tuple[int, str, str]]:
    """(taxon_id, taxon, seq) from sequential or interleaved PHYLIP; ids count from 1.

    The first blocks carry labels. In the sequential form a sequence may go on over lines until it has its length."""
    lines = text.split("\n")
    head = re.fullmatch(r"\s*(\d+)\s+(\d+)\s*", lines[0] if lines else "")
    if not head or not int(head[1]) or not int(head[2]):
        raise ValueError("two positive numbers are expected first")
    n, width = int(head[1]), int(head[2])
    body = [x.split() for x in lines[1:] if x.strip()]
    for form in (_sequential, _interleaved):
        rows = form(body, n, width)
        if rows:
            return [(i + 1, name, seq) for i, (name, seq) in enumerate(rows)]
    raise ValueError(f"{n} sequences of {width} characters are expected")


def _sequential(body: list[list[str]], n: int, width: int) -> list[tuple[str, str]] | None:
    out, i = [], 0
    while i < len(body) and len(out) < n:
        name, seq = body[i][0], "".join(body[i][1:])
        i += 1
        while len(seq) < width and i < len(body):
            seq += "".join(body[i])
            i += 1
        if len(seq) != width:
            return None
        out.append((name, seq))
    return out if len(out) == n and i == len(body) else None


def _interleaved(body: list[list[str]], n: int, width: int) -> list[tuple[str, str]] | None:
    if len(body) < n:
        return None
    names, seqs = [x[0] for x in body[:n]], ["".join(x[1:]) for x in body[:n]]
    for i, x in enumerate(body[n:]):
        seqs[i % n] += "".join(x)
    return list(zip(names, seqs, strict=True)) if all(len(s) == width for s in seqs) else None


def parse_fasta(text: str, aligned: bool = True) -> list[tuple[int, str, str]]:
    """(taxon_id, taxon, seq); headers are trimmed; aligned sequences must have one length."""
    out: list[tuple[int, str, str]] = []
    for block in text.split(">")[1:]:
        name, _, rest = block.partition("\n")
        seq = "".join(rest.split())
        if not re.fullmatch(r"[A-Za-z0-9?*.\-]*", seq):
            raise ValueError(f"a foreign character in {name.strip()!r}")
        out.append((len(out) + 1, name.strip(), seq))
    if not out:
        raise ValueError("no record")
    if aligned and len({len(s) for _, _, s in out}) > 1:
        raise ValueError("sequences differ in length")
    return out


def write_phylip(rows: Iterable[tuple[str, str]]) -> str:
    rows = list(rows)
    return f"{len(rows)} {len(rows[0][1]) if rows else 0}\n" + "".join(f"{n} {s}\n" for n, s in rows)


def write_fasta(rows: Iterable[tuple[str, str]], width: int = 0) -> str:
    cut = lambda s: "\n".join(s[i : i + width] for i in range(0, len(s), width)) if width else s
    return "".join(f">{n}\n{cut(s)}\n" for n, s in rows)


#: Names of amino-acid models that a partition line may carry.
AMINO_MODELS = "DAYHOFF DCMUT JTT MTREV WAG RTREV CPREV VT BLOSUM62 MTMAM LG MTART MTZOA PMB HIVB HIVW JTTDCMUT FLU STMTREV LG4M LG4X AUTO GTR".split()


def parse_partitions(text: str) -> list[dict]:
    """Specifications from lines `MODEL, name = a-b/s, ...`.

    A model is DNA, BIN or an amino-acid model; `ASC_` before it asks for the ascertainment correction, `F` after an
    amino-acid model for empirical frequencies, `X` after any for fitted ones. Unknown models are refused."""
    out = []
    for number, line in enumerate(x for x in text.split("\n") if x.strip()):
        m = re.fullmatch(r"\s*([^,\s]+)\s*,\s*([^=]+?)\s*=\s*(.+?)\s*", line)
        if not m:
            raise ValueError(f"line {number + 1}: MODEL, name = regions is expected")
        model, asc = m[1].upper(), False
        if model.startswith("ASC_"):
            model, asc = model[4:], True
        freqs = "model"
        known = {"DNA", "BIN", *AMINO_MODELS}
        if model not in known and model[-1:] in "FX" and model[:-1] in known:
            model, freqs = model[:-1], {"F": "empirical", "X": "fitted"}[model[-1]]
        if model not in known or freqs == "empirical" and model in ("DNA", "BIN"):
            raise ValueError(f"line {number + 1}: unknown model {m[1]}")
        regions = []
        for part in m[3].split(","):
            r = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?(?:[/\\]\s*(\d+)\s*)?", part)
            if not r or int(r[1]) < 1 or (r[2] and int(r[2]) < int(r[1])) or (r[3] and int(r[3]) < 1):
                raise ValueError(f"line {number + 1}: bad region {part.strip()!r}")
            regions.append((int(r[1]), int(r[2] or r[1]), int(r[3] or 1)))
        out.append({"ord": len(out), "model": model, "asc": asc, "freq_mode": "empirical" if freqs == "model" and model in ("DNA", "BIN") else freqs, "name": m[2], "regions": regions})
    return out


def write_partitions(specs: Sequence[dict]) -> str:
    lines = []
    for s in specs:
        regions = ", ".join(f"{a}-{b}" + (f"/{k}" if k != 1 else "") for a, b, k in s["regions"])
        tail = {"empirical": "F", "fitted": "X"}.get(s["freq_mode"], "") if s["model"] not in ("DNA", "BIN") else "X" if s["freq_mode"] == "fitted" else ""
        lines.append(f"{'ASC_' if s['asc'] else ''}{s['model']}{tail}, {s['name']} = {regions}")
    return "".join(x + "\n" for x in lines)


def parse_exclusions(text: str) -> list[tuple[int, int]]:
    """(lo, hi) of each `a-b` or `a` in an exclusion file."""
    return [(int(m[1]), int(m[2] or m[1])) for m in re.finditer(r"(\d+)(?:\s*-\s*(\d+))?", text)]


def paired_sites(text: str) -> list[tuple[int, int]]:
    """Pairs of sites from a secondary-structure line: (), [], {} and <> each match by depth; `.` is unpaired."""
    stacks: dict[str, list[int]] = {c: [] for c in "([{<"}
    close, out = dict(zip(")]}>", "([{<", strict=True)), []
    for i, c in enumerate("".join(text.split()), 1):
        if c in stacks:
            stacks[c].append(i)
        elif c in close:
            if not stacks[close[c]]:
                raise ValueError(f"site {i}: nothing to pair with")
            out.append((stacks[close[c]].pop(), i))
        elif c != ".":
            raise ValueError(f"site {i}: {c!r}")
    if any(stacks.values()):
        raise ValueError("brackets are left open")
    return sorted(out)


#: The numbers that follow the name of a substitution model in a parameter text.
MODEL_NUMBERS = {"F84": 1, "TN93": 2, "GTR": 6}


def parse_parameters(text: str) -> dict:
    """The settings of the statistical aligner from a text of words: the frequencies of A, C, G, T, the rate of insertions, the mean
    fragment length, the length of simulated sequences, the length of resampled pieces, the kind of output (ML, MS or MP), the model
    (F84, TN93 or GTR) and its numbers."""
    words = text.split()
    if len(words) < 10:
        raise ValueError("ten settings are expected")
    freqs, (rate, fragment) = [float(x) for x in words[:4]], [float(x) for x in words[4:6]]
    sample, piece, output, model = int(words[6]), int(words[7]), words[8].upper(), words[9].upper()
    if model not in MODEL_NUMBERS:
        raise ValueError(f"unknown model {words[9]!r}")
    numbers = [float(x) for x in words[10 : 10 + MODEL_NUMBERS[model]]]
    problems = {
        "frequencies must be above 0 and add up to 1": min(freqs) <= 0 or abs(sum(freqs) - 1) > 1e-6,
        "the rate must be above 0": rate <= 0,
        "fragments are at least 1 long": fragment < 1,
        "lengths must be above 0": sample < 1 or piece < 1,
        "the output is ML, MS or MP": output not in ("ML", "MS", "MP"),
        f"{model} needs {MODEL_NUMBERS[model]} numbers, none below 0": len(numbers) < MODEL_NUMBERS[model] or min(numbers) < 0,
    }
    found = [k for k, bad in problems.items() if bad]
    if found:
        raise ValueError("; ".join(found))
    return {"freqs": tuple(freqs), "rate": rate, "fragment": fragment, "sample": sample, "piece": piece, "output": output, "model": model, "numbers": tuple(numbers)}


def parse_leaves(text: str) -> list[tuple[str, float]]:
    """(name, length) of each `name:length`, the leaves of a star, with or without brackets round them."""
    found = re.findall(r"([^\s(),:;]+)\s*:\s*([0-9.eE+-]+)", text)
    if not found or len({n for n, _ in found}) < len(found):
        raise ValueError("leaves as name:length, each once, are expected")
    return [(n, float(t)) for n, t in found]
