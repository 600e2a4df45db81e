"""Fitting branch lengths and model parameters: driver loops in which each step is one aggregate query.

All edges, or all trial values of a parameter, are evaluated in the same job, so the number of jobs is the number of steps,
not of edges or values. Steps are taken only if the log-likelihood rises, so it never falls.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from ..functions.branch import Z_MAX, Z_MIN
from ..plans.model import ALPHA_MAX, ALPHA_MIN, FREQ_MIN, RATE_MAX, RATE_MIN, Model, criteria, expand_symmetry
from ..plans.tree import Tree
from .likelihood import edge_derivatives, loglik_many

T_MIN, T_MAX = -math.log(Z_MAX), -math.log(Z_MIN)


def newton_lengths(patterns: DataFrame, tree: Tree, model: Model, epsilon: float = 1e-3, most_steps: int | None = None, edges: Sequence[tuple[int, int]] | None = None) -> tuple[Tree, float]:
    """All (or the given) branch lengths by Newton steps on every edge at once, shortened together until lnl rises;
    until a step gains less than epsilon (or so many steps)."""
    lnl = loglik_many(patterns, [(tree, model)])[0]
    chosen = {(min(e), max(e)) for e in edges} if edges is not None else set(tree.edges)
    for _ in count() if most_steps is None else range(most_steps):
        step = {}
        for e, (d1, d2) in edge_derivatives(patterns, tree, model).items():
            if e in chosen:
                t = tree.length[e]
                # uphill where the curve is convex: a factor in the direction of the slope
                to = t - d1 / d2 if d2 < 0 else t * (2.0 if d1 > 0 else 0.5)
                step[e] = min(max(to, t / 8, T_MIN), t * 8 + 0.05, T_MAX)
        shares = (1.0, 0.6, 0.3, 0.1, 0.02)
        trials = [tree.with_lengths({e: tree.length[e] + f * (to - tree.length[e]) for e, to in step.items()}) for f in shares]
        got = loglik_many(patterns, [(t, model) for t in trials])
        best = int(np.argmax(got))
        if got[best] <= lnl + epsilon:
            if got[best] > lnl:
                tree, lnl = trials[best], got[best]
            break
        tree, lnl = trials[best], got[best]
    return tree, lnl


def bracket_search(evaluate, low: float, high: float, start: float, points: int = 8, rounds: int = 5) -> tuple[float, float]:
    """The best value on a logarithmic scale: a grid of trial values per job, then a finer one round the best."""
    a, b = math.log(low), math.log(high)
    best, top = start, evaluate([start])[0]
    for _ in range(rounds):
        xs = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        got = evaluate(xs)
        k = int(np.argmax(got))
        if got[k] > top:
            best, top = xs[k], got[k]
        width = (b - a) / (points - 1)
        a, b = max(math.log(low), math.log(best) - width), min(math.log(high), math.log(best) + width)
    return best, top


def optimise_alpha(patterns: DataFrame, tree: Tree, model: Model, categories: int = 4, median: bool = False) -> tuple[Model, float]:
    def evaluate(alphas: Sequence[float]) -> list[float]:
        return loglik_many(patterns, [(tree, model.with_alpha(a, categories, median)) for a in alphas])

    best, lnl = bracket_search(evaluate, ALPHA_MIN, min(ALPHA_MAX, 100.0), model.alpha or 1.0)
    return model.with_alpha(best, categories, median), lnl


def optimise_rates(patterns: DataFrame, tree: Tree, model: Model, symmetry: str | None = None, sweeps: int = 2) -> tuple[Model, float]:
    """Exchangeabilities relative to the last group, one group after the other, each by a bracket search."""
    n = len(model.rates)
    symmetry = symmetry or ",".join(map(str, range(n)))
    groups = [int(x) for x in symmetry.split(",")]
    values = [model.rates[groups.index(g)] for g in range(max(groups) + 1)]
    fixed = groups[-1]
    lnl = loglik_many(patterns, [(tree, model)])[0]
    for _ in range(sweeps):
        for g in range(len(values)):
            if g == fixed:
                continue

            def evaluate(xs: Sequence[float], g: int = g) -> list[float]:
                return loglik_many(patterns, [(tree, replace(model, rates=expand_symmetry(symmetry, [*values[:g], x, *values[g + 1 :]]), _eigen={})) for x in xs])

            best, top = bracket_search(evaluate, max(RATE_MIN, values[g] / 32), min(RATE_MAX, values[g] * 32), values[g], rounds=3)
            if top > lnl:
                values[g], lnl = best, top
    return replace(model, rates=expand_symmetry(symmetry, values), _eigen={}), lnl


def optimise_frequencies(patterns: DataFrame, tree: Tree, model: Model, sweeps: int = 1) -> tuple[Model, float]:
    """State frequencies through their exponents (a softmax), one after the other, floored."""
    x = np.log(np.array(model.freqs))
    lnl = loglik_many(patterns, [(tree, model)])[0]

    def made(v: np.ndarray) -> Model:
        f = np.maximum(np.exp(v) / np.exp(v).sum(), FREQ_MIN)
        return replace(model, freqs=tuple((f / f.sum()).tolist()), _eigen={})

    for _ in range(sweeps):
        for s in range(len(x) - 1):
            steps = np.linspace(-0.5, 0.5, 11)
            got = loglik_many(patterns, [(tree, made(x + d * (np.arange(len(x)) == s))) for d in steps])
            k = int(np.argmax(got))
            if got[k] > lnl:
                x[s], lnl = x[s] + steps[k], got[k]
    return made(x), lnl


def optimise_mixture(patterns: DataFrame, tree: Tree, model: Model, sweeps: int = 1) -> tuple[Model, float]:
    """Weights and rates of the categories of a mixture, one after the other, kept at a mean rate of 1."""
    lnl = loglik_many(patterns, [(tree, model)])[0]

    def made(weights: np.ndarray, rates: np.ndarray) -> Model:
        w = weights / weights.sum()
        r = np.clip(rates / (w @ rates), RATE_MIN, 1e3)
        return replace(model, weights=tuple(w.tolist()), site_rates=tuple(r.tolist()), _eigen={})

    for _ in range(sweeps):
        for k in range(len(model.site_rates)):
            for what in (0, 1):
                now = [model.category_weights, np.array(model.site_rates)]
                trials = []
                for f in np.exp(np.linspace(-1.2, 1.2, 9)):
                    new = [x.copy() for x in now]
                    new[what][k] *= f
                    trials.append(made(*new))
                got = loglik_many(patterns, [(tree, t) for t in trials])
                best = int(np.argmax(got))
                if got[best] > lnl:
                    model, lnl = trials[best], got[best]
    return model, lnl


def optimise_model(patterns: DataFrame, tree: Tree, model: Model, epsilon: float = 0.1, most_rounds: int | None = None, symmetry: str | None = None) -> tuple[Tree, Model, float]:
    """Rates, alpha and branch lengths in turn until lnl gains less than epsilon (or so many rounds)."""
    lnl = -math.inf
    for _ in count() if most_rounds is None else range(most_rounds):
        model, _ = optimise_rates(patterns, tree, model, symmetry, 1)
        if model.alpha is not None:
            model, _ = optimise_alpha(patterns, tree, model, len(model.site_rates))
        tree, now = newton_lengths(patterns, tree, model, epsilon)
        if now - lnl < epsilon:
            return tree, model, max(lnl, now)
        lnl = now
    return tree, model, lnl


def both_frequencies(models: dict[str, tuple[Model, int]], counted: Sequence[float]) -> dict[str, tuple[Model, int]]:
    """The models, and each again as `<name>+F` with the counted frequencies, which cost a parameter less than there are states."""
    return models | {f"{n}+F": (replace(m, freqs=tuple(float(x) for x in counted), _eigen={}), k + m.states - 1) for n, (m, k) in models.items()}


def select_model(patterns: DataFrame, tree: Tree, models: dict[str, tuple[Model, int]], n_sites: int, criterion: str = "bic") -> tuple[str, dict[str, dict[str, float]]]:
    """The best of named (model, free parameters) by a criterion (`lnl`, `aic`, `aicc`, `bic`); one job scores them all."""
    lnls = loglik_many(patterns, [(tree, m) for m, _ in models.values()])
    table = {name: {"lnl": lnl} | criteria(lnl, k, n_sites) for (name, (_, k)), lnl in zip(models.items(), lnls, strict=True)}
    pick = min(table, key=lambda n: (-table[n]["lnl"] if criterion == "lnl" else table[n][criterion], n))
    return pick, table
