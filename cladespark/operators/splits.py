"""Trees in tables: nodes, splits as bitmaps, distances and support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tree import Tree, newick_nodes

NODES = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("is_tip", T.BooleanType()), T.StructField("rank", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])


def tip_ranges(nodes: Sequence[tuple[int, int | None, bool]]) -> dict[int, tuple[int, int]]:
    """For each (node, parent, is tip), listed with parents before children, the first and last of the tips below it, which are
    numbered from 0 in depth-first order."""
    kids: dict[int | None, list[int]] = {}
    for node, parent, _ in nodes:
        kids.setdefault(parent, []).append(node)
    tips, known = {n for n, _, leaf in nodes if leaf}, {n for n, _, _ in nodes}
    out: dict[int, tuple[int, int]] = {}
    count = 0
    todo = [(n, False) for n, p, _ in reversed(nodes) if p not in known]
    while todo:
        node, done = todo.pop()
        if done:
            below = [out[k] for k in kids.get(node, [])] + ([out[node]] if node in out else [])
            out[node] = min(x[0] for x in below), max(x[1] for x in below)
            continue
        if node in tips:
            out[node] = count, count
            count += 1
        if kids.get(node):
            todo.append((node, True))
            todo += [(k, False) for k in reversed(kids[node])]
    return out


def nodes_of_text(trees: DataFrame) -> DataFrame:
    """Node rows of (tree_id, newick), each with its range of tips; a text that is no tree gives no rows."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for i, text in zip(batch["tree_id"], batch["newick"], strict=True):
                try:
                    found = newick_nodes(text or "")
                    at = tip_ranges([(n, p, leaf) for n, p, _, _, _, leaf, _ in found])
                    rows += [(i, n, p, d, name, t, leaf, k, *at[n]) for n, p, d, name, t, leaf, k in found]
                except ValueError:
                    continue
            out = pd.DataFrame(rows, columns=NODES.names)
            yield out.astype({"tree_id": "int64", "node_id": "int32", "parent_id": "int32", "depth": "int32", "is_tip": "bool", "rank": "int32", "lo": "int32", "hi": "int32"})

    return trees.select("tree_id", "newick").mapInPandas(run, NODES)


def rows_of_text(trees: DataFrame) -> DataFrame:
    """The rows of tree_rows from (tree_id, newick) texts, parsed in tasks."""
    found = nodes_of_text(trees)
    return found.select("tree_id", F.col("node_id").alias("node"), F.expr("if(parent_id < 0, null, parent_id)").alias("parent"), F.expr("if(is_tip, name, null)").alias("tip"), "t", "lo", "hi")


def tree_rows(spark: SparkSession, trees: Sequence[Tree]) -> DataFrame:
    """(tree_id, node, parent, tip, t, lo, hi), seen from each tree's root, whose parent is null; lo and hi: see tip_ranges."""
    rows = []
    for i, t in enumerate(trees):
        down = t.postorder()
        at = tip_ranges([(n, p, t.is_tip(n)) for n, p in reversed(down)])
        rows += [(i, n, p, t.name.get(n), t.t(n, p) if p is not None else None, *at[n]) for n, p in down]
    return spark.createDataFrame(rows, "tree_id int, node int, parent int, tip string, t double, lo int, hi int")


def tip_numbers(nodes: DataFrame) -> DataFrame:
    """(tip, k): k = 0, 1, ... over the distinct tip names of all trees, shorter names first."""
    tips = nodes.where("tip is not null").select("tip").distinct()
    return tips.select("tip", (F.row_number().over(Window.orderBy(F.length("tip"), "tip")) - 1).alias("k"))  # one row for each taxon


def splits(nodes: DataFrame, trivial: bool = False) -> DataFrame:
    """(tree_id, split): for every edge the tips on the side without the first tip, as a bitmap of 64 tips to a number.

    The tips below a node are a range of the tree's tips in depth-first order, so one aggregation gives each tree's order, and every
    split is a slice of it: the plan has the same size for trees of any depth and any number of tips."""
    numbers = tip_numbers(nodes)
    tips = nodes.where("tip is not null").join(numbers, "tip").groupBy("tree_id").agg(F.expr("transform(array_sort(collect_list(struct(lo, k))), x -> x.k)").alias("ks"))  # one number for each tip of a tree
    total = numbers.agg(F.count("*").cast("int").alias("n"))
    edges = nodes.where("parent is not null").select("tree_id", "lo", "hi").join(tips, "tree_id").crossJoin(F.broadcast(total))  # one row
    sides = edges.withColumn("below", F.expr("slice(ks, lo + 1, hi - lo + 1)")).withColumn("side", F.expr("if(array_contains(below, 0), array_except(ks, below), below)"))
    if not trivial:
        sides = sides.where("size(side) > 1 and size(side) < size(ks) - 1")
    bits = "transform(sequence(0, (n - 1) div 64), b -> aggregate(filter(side, k -> k div 64 = b), 0L, (x, k) -> x | shiftleft(1L, cast(k % 64 as int))))"
    return sides.select("tree_id", F.expr(bits).alias("split")).distinct()


def robinson_foulds(found: DataFrame, n_tips: int) -> DataFrame:
    """(a, b, rf, rf_norm) of each pair of trees a < b: sizes less twice the common splits, which meet by an equi join.

    The result has a row for each pair, so it grows with the square of the number of trees; only (tree, size) rows are paired."""
    size = found.groupBy("tree_id").agg(F.count("*").alias("n"))
    a, b = found.select(F.col("tree_id").alias("a"), "split"), found.select(F.col("tree_id").alias("b"), "split")
    common = a.join(b, "split").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    pairs = size.select(F.col("tree_id").alias("a"), F.col("n").alias("na")).join(size.select(F.col("tree_id").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = pairs.join(common, ["a", "b"], "left")
    rf = F.col("na") + F.col("nb") - 2 * F.coalesce("c", F.lit(0))
    return both.select("a", "b", rf.alias("rf"), (rf / (2.0 * (n_tips - 3))).alias("rf_norm"))


def support(found: DataFrame, n_trees: int) -> DataFrame:
    """(split, n, share) over all trees."""
    return found.groupBy("split").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(n_trees)))
