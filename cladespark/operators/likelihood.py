"""Log-likelihoods of site patterns on a tree.

Two evaluators of one definition. `site_loglik` builds column expressions, one projection for each inner node, which stay
in generated code; it suits trees whose columns (inner nodes x categories x states) are a few hundred. The Arrow kernel
holds the tree as a plan and works on numpy batches: any number of taxa, states and categories, with an exponent per
row against underflow, and many trees, models or edges in one job. A row is a pattern; nothing but sums is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alphabet import DNA, Alphabet
from ..plans.model import Model
from ..plans.tree import Tree
from .alignment import as_arrays, state_columns

#: Columns that the expression form may make before the Arrow form is taken.
MOST_COLUMNS = 400


def mask_table(alphabet: Alphabet) -> np.ndarray:
    """[code, state] 1 where the code may be the state."""
    out = np.zeros((max(alphabet.masks) + 1, alphabet.states))
    for code, mask in alphabet.masks.items():
        out[code] = [(mask >> s) & 1 for s in range(alphabet.states)]
    return out


# expression form ----------------------------------------------------------------------------------------------


def _tip_column(code: Column, p: np.ndarray, masks: np.ndarray, state: int) -> Column:
    """Probability of the tip's code given the state above it, looked up by code."""
    values = [float(masks[k] @ p[state]) for k in range(1, len(masks))]
    return F.element_at(F.array(*map(F.lit, values)), code)


def node_columns(patterns: DataFrame, tree: Tree, model: Model, keep: Sequence[str], root: int | None = None, alphabet: Alphabet = DNA) -> tuple[DataFrame, dict[int, list[list[str]]]]:
    """A projection for each inner node; gives the frame and the columns [category][state] of the root.

    Tip k (its place among the sorted tip names) reads the k-th state column. Codes start at 1."""
    masks = mask_table(alphabet)
    cs = state_columns(patterns)
    place = {tree.tip[n]: cs[i] for i, n in enumerate(sorted(tree.tip, key=lambda x: (len(x), x)))}
    have: dict[int, list[list[str]]] = {}
    df = patterns
    for node, parent in tree.postorder(root):
        if tree.is_tip(node):
            continue
        kids = [n for n in tree.near[node] if n != parent]
        names, made = [], []
        for r, rate in enumerate(model.site_rates):
            row = []
            ps = {k: model.component(r).p(tree.t(node, k), rate) for k in kids}
            for s in range(model.states):
                value = None
                for k in kids:
                    if tree.is_tip(k):
                        part = _tip_column(F.col(place[k]), ps[k], masks, s)
                    else:
                        part = sum((F.lit(float(ps[k][s, j])) * F.col(c) for j, c in enumerate(have[k][r][1:], 1)), F.lit(float(ps[k][s, 0])) * F.col(have[k][r][0]))
                    value = part if value is None else value * part
                name = f"n{node}_{r}_{s}"
                row.append(name)
                made.append(value.alias(name))
            names.append(row)
        for k in kids:
            have.pop(k, None)
        alive = [c for h in have.values() for row in h for c in row]
        df = df.select(*cs, *keep, *alive, *made)
        have[node] = names
    return df, have


def site_likelihood(model: Model, columns: list[list[str]]) -> Column:
    w = model.category_weights
    parts = []
    for r, row in enumerate(columns):
        f = model.component(r).freqs
        parts += [F.lit(float(w[r] * f[s])) * F.col(c) for s, c in enumerate(row)]
    return sum(parts[1:], parts[0])


def _wide(tree: Tree, model: Model) -> bool:
    """Whether the expression form would need too many columns."""
    return (len(tree.edges) + 1 - len(tree.names)) * len(model.site_rates) * model.states > MOST_COLUMNS


def site_loglik(patterns: DataFrame, tree: Tree, model: Model, keep: Sequence[str] = ("w",), alphabet: Alphabet = DNA) -> DataFrame:
    """patterns with their log-likelihood `lnl`: by column expressions, or by the Arrow form for trees of any size."""
    cs = state_columns(patterns)
    if _wide(tree, model):
        kernel = Kernel(tree, model, alphabet)
        return _by_kernel(patterns, keep, lambda codes: [kernel.lnl(codes)], ["lnl"])
    df, have = node_columns(patterns, tree, model, keep, alphabet=alphabet)
    return df.select(*cs, *keep, F.log(F.abs(site_likelihood(model, have[tree.root]))).alias("lnl"))


def tree_loglik(patterns: DataFrame, tree: Tree, model: Model, by: Sequence[str] = ()) -> DataFrame:
    """(by, lnl): the weighted sum over patterns, per group if asked."""
    return site_loglik(patterns, tree, model, ("w", *by)).groupBy(*by).agg(F.sum(F.col("w") * F.col("lnl")).alias("lnl"))


def corrected_for_invariant(patterns: DataFrame, tree: Tree, model: Model) -> DataFrame:
    """(lnl, p_constant, lnl_corrected): data without constant columns, conditioned on that: -W * log(1 - p(constant))."""
    spark, cs = patterns.sparkSession, state_columns(patterns)
    dummies = spark.createDataFrame([tuple([1 << s] * len(cs)) for s in range(model.states)], ", ".join(f"{c} int" for c in cs)).withColumn("w", F.lit(0).cast("long"))
    rows = patterns.select(*cs, "w", F.lit(0).alias("dummy")).union(dummies.select(*cs, "w", F.lit(1).alias("dummy")))
    each = site_loglik(rows, tree, model, ("w", "dummy"))
    sums = each.agg(F.sum(F.expr("if(dummy = 0, w * lnl, 0D)")).alias("lnl"), F.sum(F.expr("if(dummy = 1, exp(lnl), 0D)")).alias("p_constant"), F.sum("w").alias("n"))
    return sums.select("lnl", "p_constant", (F.col("lnl") - F.col("n") * F.log(1 - F.col("p_constant"))).alias("lnl_corrected"))


def loglik_by_category(patterns: DataFrame, tree: Tree, model: Model, category: str, rates: Sequence[float]) -> DataFrame:
    """One rate per site: (category, n, lnl), each pattern at the rate of its category column only, in one pass."""
    kernels = [Kernel(tree, Model(model.freqs, model.rates, (float(r),), name=model.name)) for r in rates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at, out = _codes(batch), np.asarray(batch.column(category)), np.zeros(batch.num_rows)
            for k, kernel in enumerate(kernels):
                if (at == k).any():
                    out[at == k] = kernel.lnl(codes[at == k])
            yield pa.RecordBatch.from_arrays([batch.column(category), batch.column("w"), pa.array(out)], [category, "w", "lnl"])

    rows = as_arrays(patterns).where(F.col(category).between(0, len(rates) - 1)).select("states", F.col(category).cast("int").alias(category), F.col("w").cast("long").alias("w"))
    each = rows.mapInArrow(run, f"{category} int, w long, lnl double")
    return each.groupBy(category).agg(F.sum("w").alias("n"), F.sum(F.expr("w * lnl")).alias("lnl"))


def ancestral(patterns: DataFrame, tree: Tree, model: Model, node: int, keep: Sequence[str] = ("w",), alphabet: Alphabet = DNA) -> DataFrame:
    """Marginal probabilities p0 ... of the states at an inner node, and the letter (`?` where all are within 1e-6 of equal)."""
    ps = [F.col(f"p{s}") for s in range(model.states)]
    if _wide(tree, model):
        kernel = Kernel(tree, model, alphabet, node)
        return _with_letters(_by_kernel(patterns, keep, lambda codes: list(kernel.marginal(codes).T), [f"p{s}" for s in range(model.states)]), ps, alphabet)
    df, have = node_columns(patterns, tree, model, keep, root=node, alphabet=alphabet)
    w, cols = model.category_weights, have[node]
    raw = [sum((F.lit(float(w[r] * model.component(r).freqs[s])) * F.col(row[s]) for r, row in enumerate(cols[1:], 1)), F.lit(float(w[0] * model.component(0).freqs[s])) * F.col(cols[0][s])) for s in range(model.states)]
    df = df.select(*state_columns(patterns), *keep, *[x.alias(f"r{s}") for s, x in enumerate(raw)])
    total = sum((F.col(f"r{s}") for s in range(1, model.states)), F.col("r0"))
    df = df.select(*state_columns(patterns), *keep, *[(F.col(f"r{s}") / total).alias(f"p{s}") for s in range(model.states)])
    return _with_letters(df, ps, alphabet)


def _with_letters(df: DataFrame, ps: list[Column], alphabet: Alphabet) -> DataFrame:
    flat = F.greatest(*[F.abs(p - 1 / len(ps)) for p in ps]) < 1e-6
    best = F.lit(alphabet.letters[len(ps) - 1])
    for s in range(len(ps) - 2, -1, -1):
        best = F.when(ps[s] >= F.greatest(*ps), alphabet.letters[s]).otherwise(best)
    return df.withColumn("ch", F.when(flat, "?").otherwise(best))


# Arrow form ---------------------------------------------------------------------------------------------------


class Kernel:
    """A tree and a model as a plan over numpy batches."""

    def __init__(self, tree: Tree, model: Model, alphabet: Alphabet = DNA, root: int | None = None):
        self.tree, self.model, self.masks = tree, model, mask_table(alphabet)
        self.root = tree.root if root is None else root
        order = sorted(tree.tip, key=lambda x: (len(x), x))
        self.place = {tree.tip[n]: i for i, n in enumerate(order)}
        self.plan = [(n, p, [k for k in tree.near[n] if k != p]) for n, p in tree.postorder(self.root)]
        self.p = {e: np.stack([model.component(r).p(t, rate) for r, rate in enumerate(model.site_rates)]) for e, t in tree.length.items()}
        self.freqs = np.stack([model.component(r).freqs for r in range(len(model.site_rates))])
        self.w = model.category_weights

    def _p(self, a: int, b: int) -> np.ndarray:
        return self.p[min(a, b), max(a, b)]

    def down(self, codes: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Vectors [row, category, state] below each node, seen from the root, and the exponent of 2 taken out of each row."""
        have, scale = {}, np.zeros(len(codes))
        for node, _, kids in self.plan:
            if node in self.place:
                have[node] = np.repeat(self.masks[codes[:, self.place[node]]][:, None, :], len(self.w), axis=1)
            else:
                v = np.ones((len(codes), len(self.w), self.model.states))
                for k in kids:
                    v *= np.einsum("rij,nrj->nri", self._p(node, k), have[k])
                top = v.max(axis=(1, 2))
                exponent = np.where(top > 0, np.frexp(np.maximum(top, 1e-300))[1], 0)
                v *= np.ldexp(1.0, -exponent)[:, None, None]
                scale += exponent
                have[node] = v
        return have, scale

    def lnl(self, codes: np.ndarray) -> np.ndarray:
        have, scale = self.down(codes)
        return np.log(np.maximum(np.einsum("nri,ri,r->n", have[self.root], self.freqs, self.w), 1e-300)) + scale * math.log(2)

    def marginal(self, codes: np.ndarray) -> np.ndarray:
        """[row, state] probabilities at the root; the exponents cancel out."""
        have, _ = self.down(codes)
        v = np.einsum("nri,ri,r->ni", have[self.root], self.freqs, self.w)
        return v / v.sum(axis=1, keepdims=True)

    def derivatives(self, codes: np.ndarray, weights: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
        """For every edge the weighted sums of the first and second derivative of lnl by its length."""
        have, _ = self.down(codes)
        up: dict[int, np.ndarray] = {}
        out = {}
        for node, _, kids in reversed(self.plan):
            for k in kids:
                v = up[node].copy() if node in up else np.ones_like(have[k])
                if node in self.place:  # a tree of two tips has a tip as its root
                    v *= have[node]
                for other in kids:
                    if other != k:
                        v *= np.einsum("rij,nrj->nri", self._p(node, other), have[other])
                v /= np.maximum(v.max(axis=(1, 2)), 1e-300)[:, None, None]
                d = [self.model.component(r).p_derivatives(self.tree.t(node, k), rate) for r, rate in enumerate(self.model.site_rates)]
                s = [np.einsum("nri,ri,r,rij,nrj->n", v, self.freqs, self.w, np.stack([x[m] for x in d]), have[k], optimize=True) for m in range(3)]
                low = np.maximum(s[0], 1e-300)
                d1 = s[1] / low
                out[min(node, k), max(node, k)] = float(weights @ d1), float(weights @ (s[2] / low - d1 * d1))
                up[k] = np.einsum("rji,nrj->nri", np.stack([self.model.component(r).p(self.tree.t(node, k), rate) * self.freqs[r][:, None] / self.freqs[r][None, :] for r, rate in enumerate(self.model.site_rates)]), v)
        return out


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("states")
    return np.asarray(lists.flatten()).astype(np.int64).reshape(len(lists), -1)


def _by_kernel(patterns: DataFrame, keep: Sequence[str], work: Callable[[np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """The state columns and keep of patterns with the columns of numbers that work(codes) gives."""
    cs = state_columns(patterns)
    rows = as_arrays(patterns.select(*cs, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for name, values in zip(names, work(_codes(batch)), strict=True):
                    batch = batch.append_column(name, pa.array(np.ascontiguousarray(values, float)))
                yield batch

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("states")[i].cast("int").alias(c) for i, c in enumerate(cs)], *keep, *names)


def arrow_site_loglik(patterns: DataFrame, tree: Tree, model: Model, alphabet: Alphabet = DNA) -> DataFrame:
    """(states, w, lnl) by the Arrow form."""
    kernel = Kernel(tree, model, alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("lnl", pa.array(kernel.lnl(_codes(batch))))

    rows = as_arrays(patterns).select("states", F.col("w").cast("long").alias("w"))
    return rows.mapInArrow(run, "states array<tinyint>, w long, lnl double")


def _summed(patterns: DataFrame, work: Callable[[np.ndarray, np.ndarray], list[tuple[int, list[float]]]], width: int) -> list[tuple[int, list[float]]]:
    """work(codes, weights) over all batches, its numbers summed by key; keys are few (trees, models or edges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, values in work(_codes(batch), np.asarray(batch.column("w"), float)):
                    total[key] = total.get(key, 0) + np.array(values)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([float(v[i]) for v in total.values()]) for i in range(width))], ["key", *(f"v{i}" for i in range(width))])

    rows = as_arrays(patterns).select("states", F.col("w").cast("double").alias("w"))
    each = rows.mapInArrow(run, "key long, " + ", ".join(f"v{i} double" for i in range(width)))
    got = each.groupBy("key").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect()
    return sorted((r[0], list(r[1:])) for r in got)


def loglik_many(patterns: DataFrame, pairs: Sequence[tuple[Tree, Model]], alphabet: Alphabet = DNA) -> list[float]:
    """Log-likelihood of each (tree, model), all in one pass over the patterns."""
    kernels = [Kernel(t, m, alphabet) for t, m in pairs]
    got = dict(_summed(patterns, lambda codes, w: [(i, [float(w @ k.lnl(codes))]) for i, k in enumerate(kernels)], 1))
    return [got.get(i, [0.0])[0] for i in range(len(pairs))]


def edge_derivatives(patterns: DataFrame, tree: Tree, model: Model, alphabet: Alphabet = DNA) -> dict[tuple[int, int], tuple[float, float]]:
    """First and second derivative of the log-likelihood by the length of every edge, in one pass."""
    kernel, edges = Kernel(tree, model, alphabet), tree.edges

    def work(codes: np.ndarray, w: np.ndarray) -> list[tuple[int, list[float]]]:
        d = kernel.derivatives(codes, w)
        return [(i, list(d[e])) for i, e in enumerate(edges)]

    return {edges[k]: (v[0], v[1]) for k, v in _summed(patterns, work, 2)}


def corrected_derivatives(patterns: DataFrame, tree: Tree, model: Model, alphabet: Alphabet = DNA) -> dict[tuple[int, int], tuple[float, float]]:
    """edge_derivatives of the log-likelihood conditioned on there being no constant column (see corrected_for_invariant).

    With P the probability of a constant column over W sites, -W log(1 - P) adds W P' / (1 - P) and W (P'' / (1 - P) + (P' / (1 - P))^2);
    P and its derivatives come from one column for each state, on the driver."""
    kernel, sites = Kernel(tree, model, alphabet), float(patterns.agg(F.sum("w")).first()[0] or 0)
    dummies = np.array([[1 << s] * len(tree.names) for s in range(model.states)])
    p = np.exp(kernel.lnl(dummies))
    each = [kernel.derivatives(dummies[s : s + 1], np.ones(1)) for s in range(model.states)]
    left, out = 1 - p.sum(), {}
    for edge, (d1, d2) in edge_derivatives(patterns, tree, model, alphabet).items():
        p1 = sum(p[s] * each[s][edge][0] for s in range(model.states)) / left
        p2 = sum(p[s] * (each[s][edge][1] + each[s][edge][0] ** 2) for s in range(model.states)) / left
        out[edge] = float(d1 + sites * p1), float(d2 + sites * (p2 + p1 * p1))
    return out


#: Log-likelihoods closer than this count as equal.
TIE = 1e-9


def best_rates(patterns: DataFrame, tree: Tree, model: Model, grid: Sequence[float], alphabet: Alphabet = DNA, halvings: int = 0) -> DataFrame:
    """(states, w, rate, lnl): the best rate of each pattern out of a grid, the smallest of equal ones (within TIE); then, by as many
    halvings, a line search from there: the rate times or over a factor that starts at the grid's mean one and whose logarithm is halved."""
    rates = np.array(sorted(grid), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_of = cache(lambda rate: Kernel(tree, Model(model.freqs, model.rates, (rate,)), alphabet))
        for batch in batches:
            if batch.num_rows:
                codes = _codes(batch)
                each = np.stack([kernel_of(float(r)).lnl(codes) for r in rates])
                best = (each >= each.max(axis=0) - TIE).argmax(axis=0)
                rate, lnl = rates[best], each[best, np.arange(each.shape[1])]
                step = np.log(rates[-1] / rates[0]) / max(1, len(rates) - 1)
                for _ in range(halvings):
                    step /= 2
                    start = rate.copy()
                    for r in np.unique(start):
                        at = np.flatnonzero(start == r)
                        for to in (r * np.exp(-step), r * np.exp(step)):
                            got = kernel_of(round(float(to), 9)).lnl(codes[at])
                            better = got > lnl[at] + TIE
                            rate[at[better]], lnl[at[better]] = round(float(to), 9), got[better]
                yield batch.append_column("rate", pa.array(rate)).append_column("lnl", pa.array(lnl))

    rows = as_arrays(patterns).select("states", F.col("w").cast("long").alias("w"))
    return rows.mapInArrow(run, "states array<tinyint>, w long, rate double, lnl double")


def optimise_site_rates(patterns: DataFrame, tree: Tree, model: Model, grid: Sequence[float], categories: int = 25, halvings: int = 4, before: tuple[Sequence[float], float] | None = None) -> tuple[list[float], float, bool]:
    """(rates, lnl, better): a rate for each pattern by line search, grouped to so many categories; each pattern at its category's rate.

    `before` has the rates in use and their log-likelihood; if the new ones are no better, it is given back."""
    rated = best_rates(patterns, tree, model, grid, halvings=halvings)
    table = rate_categories(rated, categories).collect()  # a row for each category
    rates = [float(r.rate) for r in sorted(table, key=lambda r: r.category)]
    if not rates:
        return list(before[0]) if before else [], before[1] if before else 0.0, False
    each = best_rates(patterns, tree, model, rates)
    lnl = float(each.agg(F.sum(F.col("w") * F.col("lnl"))).first()[0])
    if before and lnl <= before[1]:
        return list(before[0]), before[1], False
    return rates, lnl, True


def rate_categories(rated: DataFrame, categories: int = 25) -> DataFrame:
    """Per-site rates grouped to `categories`: the rates (to 3 digits) with the lowest summed lnl, which weigh most, stay, the others go to the
    nearest of them; rates are scaled to a weighted mean of 1. (category, rate, n, lnl)."""
    sums = rated.withColumn("rate", F.round("rate", 3)).groupBy("rate").agg(F.sum("w").alias("n"), F.sum(F.expr("w * lnl")).alias("lnl"))
    top = sums.orderBy("lnl", "rate").limit(categories).agg(F.sort_array(F.collect_list("rate")).alias("kept"))
    near = sums.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one").drop("one")
    near = near.withColumn("rate", F.expr("array_min(transform(kept, k -> struct(abs(k - rate) as d, k as k))).k"))
    grouped = near.groupBy("rate").agg(F.sum("n").alias("n"), F.sum("lnl").alias("lnl"))
    every = Window.partitionBy()
    scaled = grouped.withColumn("rate", F.col("rate") * F.sum("n").over(every) / F.sum(F.col("n") * F.col("rate")).over(every))
    return scaled.select((F.row_number().over(Window.orderBy("rate")) - 1).alias("category"), "rate", "n", "lnl")
