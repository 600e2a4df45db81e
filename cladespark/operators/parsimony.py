"""Fitch parsimony by bit operations: one tree by column expressions, many trees by numpy batches."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Tree, insert_tip, renumber, star
from .alignment import state_columns
from .likelihood import _summed


#: Trees per job.
BATCH = 512


def _order(names: Sequence[str]) -> list[str]:
    return sorted(names, key=lambda x: (len(x), x))


def fitch_fold(patterns: DataFrame, tree: Tree, keep: Sequence[str] = ("w",), place: dict[str, str] | None = None) -> DataFrame:
    """patterns with `changes`, the least number of changes on the tree; one projection for each inner node.

    At a node of more than two neighbours below, the sets are folded one after the other."""
    cs = state_columns(patterns)
    place = place or dict(zip(_order(list(tree.tip)), cs, strict=False))
    df, have = patterns.select(*cs, *keep, F.lit(0).alias("changes")), {}
    for node, parent in tree.postorder():
        if tree.is_tip(node):
            have[node] = place[tree.name[node]]
            continue
        kids = [n for n in tree.near[node] if n != parent]
        at = have.pop(kids[0])
        for i, k in enumerate(kids[1:]):
            other, name = have.pop(k), f"f{node}_{i}"
            alive = [*(x for x in have.values() if x not in cs)]
            both = f"({at} & {other})"
            df = df.select(*cs, *keep, *alive, F.expr(f"if({both} = 0, changes + 1, changes)").alias("changes"), F.expr(f"if({both} = 0, {at} | {other}, {both})").alias(name))
            at = name
        have[node] = at
    return df.select(*cs, *keep, "changes")


def score(patterns: DataFrame, tree: Tree) -> DataFrame:
    return fitch_fold(patterns, tree).agg(F.sum(F.col("w") * F.col("changes")).cast("long").alias("score"))


def _changes(codes: np.ndarray, tree: Tree, place: dict[str, int]) -> np.ndarray:
    """The least number of changes of each row of codes."""
    have, total = {}, np.zeros(len(codes), np.int64)
    for node, parent in tree.postorder():
        if tree.is_tip(node):
            have[node] = codes[:, place[tree.name[node]]]
            continue
        first, *rest = [have.pop(n) for n in tree.near[node] if n != parent]
        for other in rest:
            both = first & other
            total += both == 0
            first = np.where(both == 0, first | other, both)
        have[node] = first
    return total


def scores(patterns: DataFrame, trees: Sequence[Tree], place: dict[str, str] | None = None) -> list[int]:
    """The scores of many trees in one pass over the patterns; a row for each task and tree is summed."""
    cs = state_columns(patterns)
    place = place or dict(zip(_order(list(trees[0].tip)), cs, strict=False))
    at = {name: cs.index(c) for name, c in place.items()}
    got = dict(_summed(patterns, lambda codes, w: [(i, [float(w @ _changes(codes, t, at))]) for i, t in enumerate(trees)], 1))
    return [round(got.get(i, [0.0])[0]) for i in range(len(trees))]


def informative_patterns(patterns: DataFrame, undetermined: int = 15) -> DataFrame:
    cs = state_columns(patterns)
    return patterns.where(F.size(F.array_distinct(F.filter(F.array(*cs), lambda x: x < undetermined))) > 1)


def stepwise_addition(patterns: DataFrame, names: Sequence[str], order: Sequence[str] | None = None, seed: int | None = None) -> tuple[Tree, int]:
    """A tree by adding taxa one at a time where they cost least; all places of a step are scored in one job.

    Ties go to the first edge. names[i] reads the i-th state column. The order is that of the names, the given one, or drawn by a seed."""
    place = dict(zip(_order(names), state_columns(patterns), strict=True))
    patterns = informative_patterns(patterns).cache()
    order = list(order or _order(names))
    if seed is not None:
        random.Random(seed).shuffle(order)
    tree, best = star(order[:3]), 0
    for n in order[3:]:
        tried = [insert_tip(tree, n, e) for e in tree.edges]
        got = scores(patterns, tried, place)
        best = min(got)
        tree = tried[got.index(best)]
    patterns.unpersist()
    return renumber(tree), best


def spr_improve(patterns: DataFrame, tree: Tree, radius: int = 20, most_rounds: int | None = None) -> tuple[Tree, int]:
    """Subtree moves while the score falls (or so many rounds): the best move of each round, ties by the order of moves."""
    patterns = informative_patterns(patterns).cache()
    best = scores(patterns, [tree])[0]
    for _ in count() if most_rounds is None else range(most_rounds):
        moves = {}
        for node, at in tree.prunable():
            for edge in tree.regraft_targets(node, at, 1, radius):
                moved = tree.prune_regraft(node, at, edge)
                moves.setdefault(moved.canonical(), moved)
        tried = list(moves.values())
        got = [s for i in range(0, len(tried), BATCH) for s in scores(patterns, tried[i : i + BATCH])]
        if not got or min(got) >= best:
            break
        best = min(got)
        tree = tried[got.index(best)]
    patterns.unpersist()
    return tree, best
