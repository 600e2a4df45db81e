"""Alignments as DataFrames: cells, columns, weighted site patterns, partitions, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet

TAXA = 7

#: Regions are cut into blocks of 2^16 sites, so that no row or task holds a whole region's sites.
BLOCK_BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """The number of tasks to give to an exchange that isn't to be merged into fewer, larger ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def canonical_cells(lineitem: DataFrame) -> DataFrame:
    """(site, taxon, ch, code) of the alignment that the line items stand for; (order, line) pairs may repeat."""
    low = (F.min("l_partkey") % 4).cast("int")
    rows = lineitem.groupBy(F.col("l_orderkey").alias("site"), F.col("l_linenumber").cast("int").alias("taxon")).agg(low.alias("k"))
    return rows.select("site", "taxon", F.element_at(F.array(*map(F.lit, "ACGT")), F.col("k") + 1).alias("ch"), F.expr("shiftleft(1, k)").alias("code"))


def canonical_columns(lineitem: DataFrame, taxa: int = TAXA) -> DataFrame:
    """(site, c1 ... cn) straight from the line items in one aggregation; a missing cell is undetermined."""
    keys = [F.min(F.when(F.col("l_linenumber") == k, F.col("l_partkey"))).alias(f"k{k}") for k in range(1, taxa + 1)]
    rows = lineitem.groupBy(F.col("l_orderkey").alias("site")).agg(*keys)
    return rows.select("site", *[F.coalesce(F.expr(f"shiftleft(1, cast(k{k} % 4 as int))"), F.lit(DNA.undetermined)).alias(f"c{k}") for k in range(1, taxa + 1)])


def columns_from_cells(cells: DataFrame, taxa: Sequence[int], undetermined: int = 15) -> DataFrame:
    """(site, c<taxon> ...) from (site, taxon, code)."""
    picked = [F.max(F.when(F.col("taxon") == k, F.col("code"))).alias(f"c{k}") for k in taxa]
    return cells.groupBy("site").agg(*picked).fillna(undetermined)


def cells_from_sequences(sequences: DataFrame, alphabet: Alphabet = DNA, by: Sequence[str] = ()) -> DataFrame:
    """(by, taxon_id, taxon, site, ch, code) from (by, taxon_id, taxon, seq); sites count from 1, foreign characters get a null code."""
    rows = sequences.select(*by, "taxon_id", "taxon", F.posexplode(F.split("seq", "")).alias("site", "ch")).where("ch <> ''")
    return rows.select(*by, "taxon_id", "taxon", (F.col("site") + 1).alias("site"), "ch", alphabet.encode(F.col("ch")).alias("code"))


def state_columns(columns: DataFrame) -> list[str]:
    return sorted((c for c in columns.columns if c[0] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def compress(columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct columns with their number as weight w, within the grouping columns."""
    return columns.groupBy(*by, *state_columns(columns)).agg(F.count("*").alias("w"))


def compress_cells(cells: DataFrame, taxa: Sequence[int]) -> DataFrame:
    """compress(columns_from_cells(cells, taxa)) for many taxa, from one (site, taxon, code) row at most for each cell, codes 1 to 15: shuffled
    and counted as numbers of 16 codes each, 4 bits a code."""
    taxa, per = list(taxa), 16
    at = F.array_position(F.array(*map(F.lit, taxa)), F.col("taxon").cast("int")) - 1  # -1: another taxon
    placed = cells.withColumn("at", at).withColumn("bits", F.expr(f"shiftleft(cast(code as long), cast(4 * pmod(at, {per}) as int))"))
    words = [f"p{j}" for j in range((len(taxa) + per - 1) // per)]
    sites = placed.groupBy("site").agg(*[F.coalesce(F.bit_or(F.when((F.col("at") >= j * per) & (F.col("at") < (j + 1) * per), F.col("bits"))), F.lit(0).cast("long")).alias(w) for j, w in enumerate(words)])
    code = lambda i: F.expr(f"cast(shiftrightunsigned(p{i // per}, {4 * (i % per)}) & 15 as int)")
    packed = sites.groupBy(*words).agg(F.count("*").alias("w"))
    return packed.select(*[F.when(code(i) == 0, DNA.undetermined).otherwise(code(i)).alias(f"c{k}") for i, k in enumerate(taxa)], "w")


def as_arrays(patterns: DataFrame) -> DataFrame:
    """The state columns as one array<tinyint> column `states`, the form of the Arrow kernels."""
    cs = state_columns(patterns)
    return patterns.select(*[c for c in patterns.columns if c not in cs], F.array(*[F.col(c).cast("tinyint") for c in cs]).alias("states"))


def pattern_numbers(columns: DataFrame) -> DataFrame:
    """(site, pattern_id): numbers 1, 2, ... in the order of the patterns.

    Patterns are far fewer than sites and are ranked alone; the sites then join them. The first columns deal the patterns into
    ordered groups that are ranked each by itself; one row for each group goes through one task, for the numbers before it."""
    cs = state_columns(columns)
    head = cs[: max(1, min(4, len(cs) - 1))]
    distinct = columns.select(*cs).distinct()
    before = Window.orderBy(*head).rowsBetween(Window.unboundedPreceding, -1)
    groups = distinct.groupBy(*head).agg(F.count("*").alias("n")).select(*head, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*head).orderBy(*cs))
    ranked = distinct.withColumn("inside", inside).join(groups, head).select(*cs, (F.col("inside") + F.col("before")).alias("pattern_id"))
    return columns.join(ranked, cs).select("site", "pattern_id")


def gap_share(columns: DataFrame, undetermined: int = 15) -> DataFrame:
    """(taxon, gaps, cells) of each taxon."""
    cs = state_columns(columns)
    sums = columns.agg(F.count("*").alias("cells"), *[F.sum((F.col(c) == undetermined).cast("long")).alias(c) for c in cs])
    return sums.select("cells", F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("taxon"), F.col(c).alias("gaps")) for c in cs])).alias("x")).select("x.taxon", "x.gaps", "cells", F.round(F.col("x.gaps") / F.col("cells"), 6).alias("share"))


def undetermined_sites(columns: DataFrame, undetermined: int = 15, least: int | None = None) -> DataFrame:
    """Sites that are undetermined in all taxa, or in at least so many."""
    cs = state_columns(columns)
    return columns.where(" + ".join(f"cast({c} = {undetermined} as int)" for c in cs) + f" >= {len(cs) if least is None else least}")


def informative(columns: DataFrame, undetermined: int = 15) -> DataFrame:
    """Adds `informative`: at least two distinct determined codes."""
    cs = state_columns(columns)
    codes = F.array_distinct(F.filter(F.array(*cs), lambda x: x < undetermined))
    return columns.withColumn("informative", F.size(codes) > 1)


def base_frequencies(patterns: DataFrame, states: int = 4, rounds: int = 8) -> DataFrame:
    """(state, freq): ambiguity codes are shared out by the frequencies of the round before, `rounds` times.

    The cells are first reduced to a count per code, so each round works on a handful of rows."""
    cs = state_columns(patterns)
    counts = patterns.select("w", F.explode(F.array(*cs)).alias("code")).groupBy("code").agg(F.sum("w").alias("n"))
    freqs = [F.lit(1.0 / states) for _ in range(states)]
    row = counts.agg(F.collect_list(F.struct("code", F.col("n").cast("double").alias("n"))).alias("codes"))  # a code per row at most
    for r in range(rounds):
        names = [f"f{r}_{s}" for s in range(states)]
        prior = row.select("codes", *[f.alias(n) for f, n in zip(freqs, names, strict=True)])
        total = " + ".join(f"cast(shiftright(x.code, {s}) & 1 as double) * {names[s]}" for s in range(states))
        sums = [F.expr(f"aggregate(codes, cast(0 as double), (a, x) -> a + x.n * (cast(shiftright(x.code, {s}) & 1 as double) * {names[s]}) / ({total}))").alias(f"s{s}") for s in range(states)]
        row = prior.select("codes", *sums)
        whole = sum((F.col(f"s{s}") for s in range(1, states)), F.col("s0"))
        freqs = [F.col(f"s{s}") / whole for s in range(states)]
    return row.select(F.posexplode(F.array(*freqs)).alias("state", "freq"))


def _block(site: Column) -> Column:
    return F.shiftright(site.cast("long"), BLOCK_BITS)


def region_blocks(regions: DataFrame) -> DataFrame:
    """(columns of regions but lo, hi and stride, block, lo, hi, stride) from regions, each inclusive: a row for each block of sites that a region
    meets, with the first and last of its sites there. A stride may be negative, from lo down to hi; a region that ends before it begins has no sites."""
    others = [c for c in regions.columns if c not in ("lo", "hi", "stride")]
    long = regions.select(*others, *[F.col(c).cast("long").alias(c) for c in ("lo", "hi", "stride")])
    step = "case when lo = hi then 1L when stride = 0 then raise_error('a region has the stride 0') else abs(stride) end"
    up = long.select(*others, F.expr("if(stride < 0, hi, lo)").alias("least"), F.expr("if(stride < 0, lo, hi)").alias("hi"), F.expr(step).alias("stride"), F.expr("stride < 0").alias("falls")).where("least <= hi")
    first = up.select(*others, F.expr("if(falls, least + (hi - least) % stride, least)").alias("first"), F.col("hi").alias("last"), "stride")
    cut = first.select("*", F.explode(F.sequence(_block(F.col("first")), _block(F.col("last")))).alias("block"))
    start = cut.withColumn("start", F.expr(f"greatest(first, shiftleft(block, {BLOCK_BITS}))"))
    ends = F.expr(f"least(last, shiftleft(block, {BLOCK_BITS}) + {(1 << BLOCK_BITS) - 1})")
    return start.select(*others, "block", F.expr("start + pmod(first - start, stride)").alias("lo"), ends.alias("hi"), "stride").where("lo <= hi")


def _holds(site: Column, lo: Column, hi: Column, stride: Column) -> Column:
    return site.between(lo, hi) & ((site - lo) % stride == 0)


def _in_block(columns: DataFrame, key: str, blocks: DataFrame) -> Column:
    """The condition of a join with region_blocks, an equi join on the block."""
    return (_block(columns[key]) == blocks["block"]) & _holds(columns[key], blocks["lo"], blocks["hi"], blocks["stride"])


def bind_partitions(columns: DataFrame, regions: DataFrame, key: str = "site") -> DataFrame:
    """columns with their partition; the range join is an equi join on blocks of sites."""
    blocks = region_blocks(regions.select("partition", "lo", "hi", "stride"))
    others = [columns[c] for c in columns.columns if c != key]
    return columns.join(blocks, _in_block(columns, key, blocks)).select(columns[key], *others, blocks["partition"])


def partition_problems(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """(n_overlap, n_uncovered, n_outside): sites in several partitions, in none, and assigned sites that don't exist.

    Assigned sites are counted block by block, each block in one task; the sites that exist look their block up."""
    blocks = region_blocks(regions).groupBy("block").agg(F.collect_list(F.struct("lo", "hi", "stride")).alias("rs"))  # the regions that meet a block
    pieces = blocks.repartition(tasks(sites.sparkSession), "block").select("block", F.explode("rs").alias("r"))
    times = pieces.select("block", F.explode(F.sequence("r.lo", "r.hi", "r.stride")).alias("site")).groupBy("block", "site").agg(F.count("*").alias("n"))
    assigned = times.agg(F.count("*").alias("assigned"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_overlap"))
    known = sites.select("site").distinct().select("site", _block(F.col("site")).alias("block")).join(blocks, "block", "left")
    met = known.select(F.coalesce(F.exists("rs", lambda r: _holds(F.col("site"), r["lo"], r["hi"], r["stride"])), F.lit(False)).cast("long").alias("met"))
    counts = met.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum(1 - F.col("met")), F.lit(0)).alias("n_uncovered"))
    return assigned.crossJoin(counts).select("n_overlap", "n_uncovered", (F.col("assigned") - F.col("met")).alias("n_outside"))


def join_tips(sequences: DataFrame, tips: DataFrame) -> DataFrame:
    """(taxon, in_alignment, in_tree) over both name sets; a load is total when both hold for every row."""
    a = sequences.select(F.col("taxon"), F.lit(True).alias("a")).distinct()
    b = tips.select(F.col("taxon"), F.lit(True).alias("b")).distinct()
    return a.join(b, "taxon", "full_outer").select("taxon", F.coalesce("a", F.lit(False)).alias("in_alignment"), F.coalesce("b", F.lit(False)).alias("in_tree"))


def check_lengths(sequences: DataFrame) -> DataFrame:
    """Sequences whose length isn't the most common one."""
    n = sequences.select("taxon", F.length("seq").alias("n"))
    usual = n.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).select(F.col("n").alias("usual"))
    return n.join(F.broadcast(usual), n["n"] != F.col("usual"))


def exclude_sites(columns: DataFrame, ranges: DataFrame) -> DataFrame:
    """columns without the sites in (lo, hi) ranges, by an anti join on blocks of sites."""
    gone = region_blocks(ranges.select("lo", "hi", F.lit(1).alias("stride")))
    return columns.join(gone, _in_block(columns, "site", gone), "left_anti")


def paired_states(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(taxon, a, b, code) for paired sites (a, b): 4 * first + second over the four determined states, else null."""
    one = cells.select("taxon", F.col("site").alias("a"), F.col("code").alias("x"))
    two = cells.select("taxon", F.col("site").alias("b"), F.col("code").alias("y"))
    both = pairs.join(one, "a").join(two, ["taxon", "b"])
    single = "bit_count(x) = 1 and bit_count(y) = 1"
    return both.select("taxon", "a", "b", F.expr(f"if({single}, cast(4 * log2(x) + log2(y) as int), null)").alias("code"))
