"""Time-reversible substitution models, rate heterogeneity, parameter linkage and rate symmetries (driver side)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.special import gamma_rates

# Bounds of the parameters.
RATE_MIN, RATE_MAX, ALPHA_MIN, ALPHA_MAX, FREQ_MIN = 1e-7, 1e6, 0.02, 1000.0, 0.001


def smooth_frequencies(freqs: Sequence[float], floor: float = FREQ_MIN) -> np.ndarray:
    """Frequencies with a least value: those below the floor are set to it, and the rest are scaled to share what is left."""
    f = np.array(freqs, float) / sum(freqs)
    if floor * len(f) > 1:
        raise ValueError("the floor leaves nothing to share")
    low = np.zeros(len(f), bool)
    while (f[~low] < floor).any():  # scaling may push more below it; each round adds at least one
        low |= f < floor
        f = np.where(low, floor, f * (1 - floor * low.sum()) / f[~low].sum())
    return f


@dataclass(frozen=True)
class Model:
    """rates: exchangeabilities of the upper triangle, row by row; site rates have equal weights unless given."""

    freqs: tuple[float, ...]
    rates: tuple[float, ...]
    site_rates: tuple[float, ...] = (1.0,)
    weights: tuple[float, ...] = ()
    alpha: float | None = None
    name: str = "GTR"
    mixture: tuple[Model, ...] = ()
    _eigen: dict = field(default_factory=dict, repr=False, compare=False, hash=False)

    @property
    def states(self) -> int:
        return len(self.freqs)

    @property
    def category_weights(self) -> np.ndarray:
        return np.array(self.weights or [1 / len(self.site_rates)] * len(self.site_rates))

    def exchange(self) -> np.ndarray:
        n = self.states
        r = np.zeros((n, n))
        r[np.triu_indices(n, 1)] = self.rates
        return r + r.T

    def q(self, normal: bool = True) -> np.ndarray:
        f = np.array(self.freqs)
        q = self.exchange() * f
        np.fill_diagonal(q, -q.sum(axis=1))
        return q / self.mean_rate if normal else q

    @property
    def mean_rate(self) -> float:
        f = np.array(self.freqs)
        return float(f @ self.exchange() @ f)

    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "e" not in self._eigen:
            root = np.sqrt(np.array(self.freqs))
            values, vectors = np.linalg.eigh(self.q() * root[:, None] / root[None, :])
            self._eigen["e"] = values, vectors / root[:, None], vectors.T * root[None, :]
        return self._eigen["e"]

    def p(self, t: float, rate: float = 1.0) -> np.ndarray:
        """Transition probabilities over t expected substitutions at a relative rate."""
        values, left, right = self.eigen()
        return np.maximum((left * np.exp(values * rate * t)) @ right, 0.0)

    def p_derivatives(self, t: float, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, left, right = self.eigen()
        v = values * rate
        e = np.exp(v * t)
        return (left * e) @ right, (left * (v * e)) @ right, (left * (v * v * e)) @ right

    def component(self, k: int) -> Model:
        """The model of rate category k: one matrix per category in a mixture, else this one."""
        return self.mixture[k] if self.mixture else self

    def with_alpha(self, alpha: float, categories: int = 4, median: bool = False) -> Model:
        alpha = min(max(alpha, ALPHA_MIN), ALPHA_MAX)
        return replace(self, alpha=alpha, site_rates=tuple(gamma_rates(alpha, categories, median).tolist()), _eigen={})

    def free_parameters(self) -> int:
        return len(self.rates) - 1 + self.states - 1 + (self.alpha is not None)


def equal(states: int, **more) -> Model:
    """All rates and frequencies equal (JC69 for four states; MK for multi-state data; Poisson for amino acids)."""
    return Model((1 / states,) * states, (1.0,) * (states * (states - 1) // 2), **({"name": "EQUAL"} | more))


def jc69(site_rates: Sequence[float] = (1.0,)) -> Model:
    return equal(4, site_rates=tuple(site_rates), name="JC69")


def ordered(states: int) -> Model:
    """Rates grow with the distance of two states."""
    return Model((1 / states,) * states, tuple(float(abs(i - j)) for i in range(states) for j in range(i + 1, states)), name="ORDERED")


def f84(freqs: Sequence[float], kappa: float) -> Model:
    """Transitions within purines and pyrimidines get kappa spread by the class frequency, on top of equal exchange."""
    a, c, g, t = freqs
    return Model(tuple(freqs), (1.0, 1 + kappa / (a + g), 1.0, 1.0, 1 + kappa / (c + t), 1.0), name="F84")


def tn93(freqs: Sequence[float], purine: float, pyrimidine: float) -> Model:
    return Model(tuple(freqs), (1.0, purine, 1.0, 1.0, pyrimidine, 1.0), name="TN93")


def named(name: str, freqs: Sequence[float], numbers: Sequence[float]) -> Model:
    """The nucleotide model of a parameter text: F84 (kappa), TN93 (purines, pyrimidines) or GTR (six rates)."""
    if name == "F84":
        return f84(freqs, *numbers)
    if name == "TN93":
        return tn93(freqs, *numbers)
    if name != "GTR":
        raise ValueError(f"unknown model {name!r}")
    return Model(tuple(freqs), tuple(float(x) for x in numbers))


def mixture(parts: Sequence[Model], site_rates: Sequence[float], weights: Sequence[float] | None = None) -> Model:
    """One matrix per rate category (four in the published mixtures); weights free or equal."""
    w = tuple(weights) if weights else (1 / len(parts),) * len(parts)
    return replace(parts[0], site_rates=tuple(site_rates), weights=w, mixture=tuple(parts), name="MIX", _eigen={})


def read_matrix(text: str, scale_to: float = 10.0) -> Model:
    """An empirical amino-acid model from the usual text form: 190 lower-triangle rates, then 20 frequencies.

    The published tables are data, not code: pass the text of a `.dat` file. Rates are scaled to a maximum of 10."""
    numbers = []
    for word in text.split()[:210]:  # what follows is comment
        try:
            numbers.append(float(word))
        except ValueError:
            raise ValueError(f"a number is expected instead of {word!r}") from None
    if len(numbers) < 210 or min(numbers) < 0:
        raise ValueError("190 rates and 20 frequencies are expected")
    r = np.zeros((20, 20))
    r[np.tril_indices(20, -1)] = numbers[:190]
    r = (r + r.T) * scale_to / max(numbers[:190])
    f = np.array(numbers[190:])
    return Model(tuple((f / f.sum()).tolist()), tuple(r[np.triu_indices(20, 1)].tolist()), name="EMPIRICAL")


def expand_symmetry(text: str, values: Sequence[float]) -> tuple[float, ...]:
    """Rates from a symmetry string such as `0,1,0,0,1,0`: equal numbers share one value; numbering starts at 0 without gaps."""
    parts = [int(x) for x in text.split(",")]
    if sorted(set(parts)) != list(range(max(parts) + 1)):
        raise ValueError("symmetry groups must be 0, 1, ... without gaps")
    if len(values) != max(parts) + 1:
        raise ValueError("one value for each group is expected")
    return tuple(float(values[p]) for p in parts)


def link(text: str, partitions: int) -> list[list[int]]:
    """Partitions of each linkage group, from a string such as `0,1,0`."""
    groups = [int(x) for x in text.split(",")]
    if len(groups) != partitions or sorted(set(groups)) != list(range(max(groups) + 1)):
        raise ValueError("one group number for each partition, numbered without gaps, is expected")
    return [[i for i, g in enumerate(groups) if g == k] for k in range(max(groups) + 1)]


def check_linkage(groups: list[list[int]], kinds: Sequence[str], states: Sequence[int], fixed: Sequence[bool]) -> list[str]:
    """Problems of a linkage: partitions in one group must share data type, number of states and whether they are fixed."""
    out = []
    for k, g in enumerate(groups):
        for what, of in (("data type", kinds), ("number of states", states), ("fixed or free", fixed)):
            if len({of[i] for i in g}) > 1:
                out.append(f"group {k}: {what} differs")
    seen = sorted(i for g in groups for i in g)
    if seen != list(range(len(kinds))):
        out.append("each partition must be in one group")
    return out


def criteria(lnl: float, k: int, n: int) -> dict[str, float]:
    """Akaike's (also corrected for small samples) and the Bayesian information criterion."""
    aic = 2 * k - 2 * lnl
    return {"aic": aic, "aicc": aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf, "bic": k * math.log(n) - 2 * lnl}
