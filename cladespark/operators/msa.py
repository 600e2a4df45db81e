"""Scores of multiple alignments (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import state_columns

#: Sites that one task numbers at a time.
RUN = 1 << 16


def pair_counts(cells: DataFrame, gap: str = "-") -> DataFrame:
    """(site, same, pairs): equal and all letter pairs of each column; counts per letter suffice, no self join."""
    letters = cells.where(F.col("ch") != gap).groupBy("site", "ch").agg(F.count("*").alias("n"))
    per = letters.groupBy("site").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("same"), F.sum("n").alias("n"))
    return per.select("site", "same", F.expr("n * (n - 1) div 2").alias("pairs"))


def sum_of_pairs(cells: DataFrame, gap: str = "-") -> DataFrame:
    """(same, different, pairs, similarity, distance) of a whole alignment."""
    total = pair_counts(cells, gap).agg(F.sum("same").alias("same"), F.sum("pairs").alias("pairs"))
    return total.select("same", (F.col("pairs") - F.col("same")).alias("different"), "pairs", F.round(F.col("same") / F.col("pairs"), 6).alias("similarity"), F.round((F.col("pairs") - F.col("same")) / F.col("pairs"), 6).alias("distance"))


def column_texts(cells: DataFrame) -> DataFrame:
    """(site, col): the letters of each column in order of taxa."""
    return cells.groupBy("site").agg(F.expr("array_join(transform(array_sort(collect_list(struct(taxon, ch))), x -> x.ch), '')").alias("col"))


def total_column(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(matched, total, score): reference columns found among the predicted ones, each predicted column used once."""
    p = predicted.groupBy("col").agg(F.count("*").alias("p"))
    r = reference.groupBy("col").agg(F.count("*").alias("r"))
    both = r.join(p, "col", "left").agg(F.sum(F.least("r", F.coalesce("p", F.lit(0)))).alias("matched"), F.sum("r").alias("total"))
    return both.select("matched", "total", F.round(F.col("matched") / F.col("total"), 6).alias("score"))


def residue_pairs(cells: DataFrame, gap: str = "-") -> DataFrame:
    """(a, b, i, j): residue i of taxon a stands over residue j of taxon b.

    Residues are numbered in runs of RUN sites, each by itself, plus the residues in the taxon's earlier runs (one row a run)."""
    held = cells.where(F.col("ch") != gap).select("taxon", "site", F.floor(F.col("site") / RUN).alias("run"))
    earlier = Window.partitionBy("taxon").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("taxon", "run").agg(F.count("*").alias("n")).select("taxon", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("taxon", "run").orderBy("site"))
    numbered = held.withColumn("inside", inside).join(runs, ["taxon", "run"]).select("taxon", "site", (F.col("inside") + F.col("before")).alias("i"))
    per = numbered.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("taxon", "i"))).alias("m"))  # one entry for each taxon
    return per.select(F.expr("explode(flatten(transform(m, (x, k) -> transform(slice(m, k + 2, size(m)), y -> struct(x.taxon as a, y.taxon as b, x.i as i, y.i as j)))))").alias("p")).select("p.*")


def confusion(predicted: DataFrame, reference: DataFrame, possible: int) -> DataFrame:
    """Homologous residue pairs: tp, fp, fn, tn, sensitivity, selectivity and the Matthews correlation."""
    on = ["a", "b", "i", "j"]
    both = predicted.select(*on, F.lit(1).alias("p")).join(reference.select(*on, F.lit(1).alias("r")), on, "full_outer")
    n = both.agg(F.sum(F.expr("if(p = 1 and r = 1, 1L, 0L)")).alias("tp"), F.sum(F.expr("if(r is null, 1L, 0L)")).alias("fp"), F.sum(F.expr("if(p is null, 1L, 0L)")).alias("fn"))
    n = n.withColumn("tn", F.lit(possible) - F.col("tp") - F.col("fp") - F.col("fn"))
    mcc = F.expr("(cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn))")
    return n.select("tp", "fp", "fn", "tn", F.round(F.expr("tp / (tp + fn)"), 6).alias("sensitivity"), F.round(F.expr("tp / (tp + fp)"), 6).alias("selectivity"), F.round(mcc, 6).alias("mcc"))


def pair_identity(patterns: DataFrame, undetermined: int = 15) -> DataFrame:
    """(a, b, same, cells, identity) of each pair of taxa, in one pass over the patterns."""
    cs = state_columns(patterns)
    pairs = [(a, b) for i, a in enumerate(cs) for b in cs[i + 1 :]]
    sums = [F.sum(F.expr(f"if({a} < {undetermined} and {b} < {undetermined}, w, 0L)")).alias(f"n{k}") for k, (a, b) in enumerate(pairs)]
    sums += [F.sum(F.expr(f"if({a} < {undetermined} and {a} = {b}, w, 0L)")).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(int(a[1:])).alias("a"), F.lit(int(b[1:])).alias("b"), F.col(f"s{k}").alias("same"), F.col(f"n{k}").alias("cells")) for k, (a, b) in enumerate(pairs)])
    return patterns.agg(*sums).select(F.explode(rows).alias("x")).select("x.*", F.round(F.col("x.same") / F.col("x.cells"), 6).alias("identity"))
