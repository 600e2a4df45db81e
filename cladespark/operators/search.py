"""Tree search: the neighbours of a tree are scored in one job per sweep, then the best or a set that doesn't conflict is taken."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame

from ..plans.model import Model
from ..plans.tree import Tree, nni_neighbours
from .likelihood import loglik_many
from .optimize import newton_lengths

#: Candidate trees per job.
BATCH = 64


@dataclass
class Move:
    kind: str
    place: tuple
    tree: Tree
    lnl: float = float("-inf")


@dataclass
class History:
    """Committed trees, newest last; immutable versions, so undoing is dropping the last."""

    versions: list[Tree] = field(default_factory=list)

    def commit(self, tree: Tree) -> Tree:
        self.versions.append(tree)
        return tree

    def rollback(self) -> Tree:
        if len(self.versions) < 2:
            raise ValueError("nothing to undo")
        self.versions.pop()
        return self.versions[-1]

    def clear(self) -> None:
        del self.versions[:-1]


class BestTrees:
    """The best k distinct topologies, by lnl, then by canonical form."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def insert(self, tree: Tree, lnl: float) -> None:
        key = tree.canonical()
        if key not in self.rows or self.rows[key][0] < lnl:
            self.rows[key] = lnl, tree
        for drop in sorted(self.rows, key=lambda x: (-self.rows[x][0], x))[self.k :]:
            del self.rows[drop]

    def recall(self, rank: int) -> tuple[Tree, float]:
        """rank 1 is the best."""
        key = sorted(self.rows, key=lambda x: (-self.rows[x][0], x))[rank - 1]
        return self.rows[key][1], self.rows[key][0]


def nni_moves(tree: Tree) -> list[Move]:
    return [Move("nni", (e, k), t) for e, k, t in nni_neighbours(tree)]


def spr_moves(tree: Tree, low: int = 1, high: int = 5) -> list[Move]:
    """One move for each distinct topology within the radius."""
    out: dict[tuple[int, ...], Move] = {}
    for node, at in tree.prunable():
        for edge in tree.regraft_targets(node, at, low, high):
            t = tree.prune_regraft(node, at, edge)
            out.setdefault(t.canonical(), Move("spr", (node, at, edge), t))
    out.pop(tree.canonical(), None)
    return list(out.values())


def tbr_moves(tree: Tree, radius: int = 3) -> list[Move]:
    out: dict[tuple[int, ...], Move] = {}
    for edge in tree.inner_edges:
        for left, right in tree.reconnect_targets(edge, radius):
            t = tree.bisect_reconnect(edge, left, right)
            out.setdefault(t.canonical(), Move("tbr", (edge, left, right), t))
    out.pop(tree.canonical(), None)
    return list(out.values())


def scored(patterns: DataFrame, moves: Sequence[Move], model: Model, top: int | None = None) -> list[Move]:
    """Moves by falling lnl; ties by canonical form."""
    for i in range(0, len(moves), BATCH):
        part = moves[i : i + BATCH]
        for m, lnl in zip(part, loglik_many(patterns, [(m.tree, model) for m in part]), strict=True):
            m.lnl = lnl
    return sorted(moves, key=lambda m: (-m.lnl, m.tree.canonical()))[:top]


def nni_sweep(patterns: DataFrame, tree: Tree, model: Model, lnl: float) -> tuple[Tree, float, int]:
    """The better swap of every inner edge, those that gain applied together if they touch no common node; where that
    loses, half of them, and so on. (tree, lnl, moves applied)."""
    gains: dict[tuple[int, int], Move] = {}
    for m in scored(patterns, nni_moves(tree), model):
        if m.lnl > lnl:
            gains.setdefault(m.place[0], m)
    chosen, used = [], set()
    for m in sorted(gains.values(), key=lambda m: (-m.lnl, m.place)):
        near = {*m.place[0], *tree.near[m.place[0][0]], *tree.near[m.place[0][1]]}
        if not near & used:
            chosen.append(m)
            used |= near
    while chosen:
        new = tree
        for m in chosen:
            new = new.swap(*m.place)
        got = loglik_many(patterns, [(new, model)])[0]
        if got > lnl:
            return new, got, len(chosen)
        if len(chosen) == 1:
            break
        chosen = chosen[: len(chosen) // 2]
    return tree, lnl, 0


def nni_search(patterns: DataFrame, tree: Tree, model: Model, most_rounds: int | None = None) -> tuple[Tree, float, int]:
    """Sweeps until no swap gains (or so many)."""
    tree, lnl = newton_lengths(patterns, tree, model, 0.1)
    applied = 0
    for _ in count() if most_rounds is None else range(most_rounds):
        new, got, n = nni_sweep(patterns, tree, model, lnl)
        if not n:
            break
        tree, lnl = newton_lengths(patterns, new, model, 0.1)
        applied += n
    return tree, lnl, applied


def spr_search(patterns: DataFrame, tree: Tree, model: Model, radius: int = 5, most_rounds: int | None = None, epsilon: float = 0.1, thorough: int = 3) -> tuple[Tree, float, int]:
    """Each round scores all moves in the radius fast, refits the branch lengths of the best few, and takes the best, until none gains epsilon
    (or so many rounds)."""
    tree, lnl = newton_lengths(patterns, tree, model, epsilon)
    applied = 0
    for _ in count() if most_rounds is None else range(most_rounds):
        best = scored(patterns, spr_moves(tree, 1, radius), model, thorough)
        fits = [newton_lengths(patterns, m.tree, model, epsilon) for m in best]
        if not fits or max(f[1] for f in fits) <= lnl + epsilon:
            break
        tree, lnl = max(fits, key=lambda f: f[1])
        applied += 1
    return tree, lnl, applied


def rapid_sweep(patterns: DataFrame, tree: Tree, model: Model, lnl: float, radius: int = 5, cutoff: float | None = None, starts: Sequence[tuple[int, int]] | None = None, keep: int = 50) -> tuple[list[Move], list[tuple[int, int]]]:
    """(moves that gain, best first; the starts of the best `keep` moves). Subtrees go outward one ring of edges at a time, and the
    rings of all subtrees are scored together. A subtree whose best place in a ring loses more than `cutoff` goes no farther (without
    one: than the mean loss in the first ring). starts: the (subtree, attachment) pairs that are tried, else all."""
    going = [s for s in tree.prunable() if starts is None or s in set(starts)]
    own, best = tree.canonical(), {}
    for ring in range(1, radius + 1):
        tried = [Move("spr", (n, a, e), tree.prune_regraft(n, a, e)) for n, a in going for e in tree.regraft_targets(n, a, ring, ring)]
        same: dict[tuple[int, ...], list[Move]] = {}
        for m in tried:
            same.setdefault(m.tree.canonical(), []).append(m)
        same.pop(own, None)
        for m in scored(patterns, [ms[0] for ms in same.values()], model):
            for other in same[m.tree.canonical()]:
                other.lnl = m.lnl
        top: dict[tuple[int, int], Move] = {}
        for m in sorted((m for ms in same.values() for m in ms), key=lambda m: (-m.lnl, m.place)):
            top.setdefault(m.place[:2], m)
        for s, m in top.items():
            if s not in best or m.lnl > best[s].lnl:
                best[s] = m
        losses = [lnl - m.lnl for m in top.values() if m.lnl < lnl]
        if cutoff is None:
            cutoff = sum(losses) / len(losses) if losses else 0.0
        going = [s for s in going if s in top and lnl - top[s].lnl <= cutoff]
    ranked = sorted(best.values(), key=lambda m: (-m.lnl, m.place))
    return [m for m in ranked if m.lnl > lnl], [m.place[:2] for m in ranked[:keep]]


def rapid_search(patterns: DataFrame, tree: Tree, model: Model, radius: int = 5, keep: int = 50, thorough: int = 3, epsilon: float = 0.1) -> tuple[Tree, float, int]:
    """Rapid sweeps until one over all subtrees gains nothing. After a sweep over all, the next ones try only the starts of its best moves,
    as long as they gain; the lengths of the best `thorough` trees of a sweep are refitted."""
    tree, lnl = newton_lengths(patterns, tree, model, epsilon)
    applied, starts = 0, None
    while True:
        moves, best = rapid_sweep(patterns, tree, model, lnl, radius, None, starts, keep)
        fits = [newton_lengths(patterns, m.tree, model, epsilon) for m in moves[:thorough]]
        if fits and max(f[1] for f in fits) > lnl + epsilon:
            tree, lnl = max(fits, key=lambda f: f[1])
            applied, starts = applied + 1, best
        elif starts is None:
            return tree, lnl, applied
        else:
            starts = None


def choose_radius(patterns: DataFrame, tree: Tree, model: Model, step: int = 5, most: int = 25) -> int:
    """5, 10, ... while the best move of a larger radius improves on the smaller one's."""
    best, radius = float("-inf"), step
    for r in range(step, most + 1, step):
        top = scored(patterns, spr_moves(tree, 1, r), model, 1)
        if not top or top[0].lnl <= best:
            break
        best, radius = top[0].lnl, r
    return radius


def ml_search(patterns: DataFrame, tree: Tree, model: Model, radius: int | None = None, stop_rf: float = 0.01, keep: int = 10) -> tuple[Tree, float, BestTrees]:
    """Nearest-neighbour sweeps, then subtree moves, until the topology changes by at most stop_rf and lnl stands still."""
    best = BestTrees(keep)
    tree, lnl, _ = nni_search(patterns, tree, model)
    best.insert(tree, lnl)
    radius = radius or choose_radius(patterns, tree, model)
    while True:
        new, got, n = spr_search(patterns, tree, model, radius)
        best.insert(new, got)
        if not n or new.robinson_foulds(tree, True) <= stop_rf:
            return (new, got, best) if got > lnl else (tree, lnl, best)
        tree, lnl = new, got
