"""Bayesian sampling of trees: chains are tasks, each over a bounded pattern table.

Proposals: topology (a nearest-neighbour swap), rates, branch lengths (a factor, whose Hastings ratio is the factor) and
the shape of the rates. Priors: exponential for branch lengths and alpha, flat for topologies and rates in bounds.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Model
from ..plans.tree import Tree
from .alignment import as_arrays
from .likelihood import Kernel

#: A chain holds the patterns in memory; beyond so many rows the batch searches are the way.
MOST_PATTERNS = 200_000
SHARES = (("topology", 0.20), ("rates", 0.05), ("length", 0.70), ("alpha", 0.05))
LENGTH_MEAN, ALPHA_MEAN = 0.1, 1.0


def _chain(codes: np.ndarray, weights: np.ndarray, tree: Tree, model: Model, seed: int, steps: int, every: int) -> Iterator[tuple]:
    rng = random.Random(seed)

    def lnl_of(t: Tree, m: Model) -> float:
        return float(weights @ Kernel(t, m).lnl(codes))

    lnl, accepted = lnl_of(tree, model), 0
    for step in range(1, steps + 1):
        x, kind = rng.random(), SHARES[-1][0]
        for name, share in SHARES:
            if x < share:
                kind = name
                break
            x -= share
        new_tree, new_model, ratio = tree, model, 0.0
        if kind == "topology" and tree.inner_edges:
            new_tree = tree.swap(rng.choice(tree.inner_edges), rng.randrange(2))
        elif kind == "rates" and len(model.rates) > 1:
            i, f = rng.randrange(len(model.rates) - 1), math.exp(0.5 * (rng.random() - 0.5))
            new_model = replace(model, rates=tuple(r * f if k == i else r for k, r in enumerate(model.rates)), _eigen={})
            ratio = math.log(f)
        elif kind == "alpha" and model.alpha is not None:
            f = math.exp(0.6 * (rng.random() - 0.5))
            new_model = model.with_alpha(model.alpha * f, len(model.site_rates))
            ratio = math.log(f) - (new_model.alpha - model.alpha) / ALPHA_MEAN
        else:
            e, f = rng.choice(tree.edges), math.exp(1.2 * (rng.random() - 0.5))
            new_tree = tree.with_lengths({e: tree.length[e] * f})
            ratio = math.log(f) - tree.length[e] * (f - 1) / LENGTH_MEAN
        got = lnl_of(new_tree, new_model)
        if math.log(max(rng.random(), 1e-300)) < got - lnl + ratio:
            tree, model, lnl, accepted = new_tree, new_model, got, accepted + 1
        if step % every == 0:
            yield step, lnl, accepted / step, float(model.alpha or 0.0), sum(tree.length.values()), ",".join(map(str, tree.canonical()))


def sample(patterns: DataFrame, tree: Tree, model: Model, chains: int = 4, steps: int = 200, every: int = 50, seed: int = 1) -> DataFrame:
    """(chain, step, lnl, accepted, alpha, tree_length, topology) of chains with seeds seed, seed + 1, ..."""
    spark = patterns.sparkSession
    rows = as_arrays(patterns).select("states", F.col("w").cast("double").alias("w"))
    held = rows.limit(MOST_PATTERNS + 1).toPandas()
    if len(held) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    held = held.sort_values("states", key=lambda s: s.map(tuple))
    sent = spark.sparkContext.broadcast((np.array(held.states.tolist(), np.int64), held.w.to_numpy()))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame.chain.iloc[0])
        out = list(_chain(*sent.value, tree, model, seed + k, steps, every))
        return pd.DataFrame([(k, *x) for x in out], columns=["chain", "step", "lnl", "accepted", "alpha", "tree_length", "topology"])

    return spark.range(chains).select(F.col("id").alias("chain")).groupBy("chain").applyInPandas(run, "chain long, step long, lnl double, accepted double, alpha double, tree_length double, topology string")
