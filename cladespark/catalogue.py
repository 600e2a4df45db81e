"""The queries of the library, one for each operator that the supplied tables can exercise, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import branch
from .functions.alphabet import AMINO, decode_state, encode_state
from .functions.alphabet import secondary as secondary_alphabet
from .functions.special import gamma_rates
from .operators import alignment as al
from .operators import likelihood as lk
from .operators import mcmc, msa, optimize, parsimony, search, splits, statalign
from .plans import model as md
from .plans import secondary, sqlgen, tree
from .sources import readers

#: The fixed tree over the seven taxa of the canonical alignment, and the rates of its four categories.
TEXT = "(5:0.1,(4:0.2,(2:0.3,(7:0.15,(3:0.1,6:0.2):0.05):0.1):0.12):0.08,1:0.25);"
TREE = tree.parse(TEXT)
JC4 = md.jc69((0.1, 0.5, 1.0, 2.4))
GTR4 = md.Model((0.3, 0.2, 0.25, 0.25), (1.2, 3.1, 0.8, 0.9, 3.4, 1.0)).with_alpha(0.7)
PSR_RATES = (0.2, 0.9, 2.2)
CANDIDATES = [TREE, *(tree.random_tree([str(i) for i in range(1, 8)], s) for s in (3, 11, 19, 27, 35))]
C = [f"c{i}" for i in range(1, 8)]
CS = ", ".join(C)
#: Trees and an alignment of more taxa than a number has bits, or than the expression form takes.
WIDE_TREES = [tree.random_tree([str(i) for i in range(1, 81)], s) for s in (2, 4, 6, 8)]
WIDE_TAXA = 49
WIDE_TREE = tree.random_tree([str(i) for i in range(1, WIDE_TAXA + 1)], 5, 0.15)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def with_base(steps: list[str], select: str) -> str:
    return "with " + ",\n".join([sqlgen.base(), *steps]) + "\n" + select


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return al.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return al.canonical_columns(lineitem(spark, sf))


def patterns(spark: SparkSession, sf: str) -> DataFrame:
    return al.compress(columns(spark, sf))


def kept_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """patterns for many passes, in memory and dealt to all cores: they are few bytes, which would come as one or two partitions, but each is much work."""
    return patterns(spark, sf).repartition(max(spark.sparkContext.defaultParallelism, 2)).cache()


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Three strided partitions of the order keys: every third from 1, from 2 and from 3."""
    top = lineitem(spark, sf).agg(F.max("l_orderkey").alias("hi"))
    return top.select(F.explode(F.array(*[F.struct(F.lit(p).alias("partition"), F.lit(p + 1).cast("long").alias("lo")) for p in range(3)])).alias("r"), "hi").select("r.partition", "r.lo", "hi", F.lit(3).cast("long").alias("stride"))


# data plane ---------------------------------------------------------------------------------------------------


@query("with " + sqlgen.base() + " select site, cast(taxon as int) as taxon, substr('ACGT', cast(k as int) + 1, 1) as ch, cast(1 << cast(k as int) as int) as code, substr('ACGT', cast(k as int) + 1, 1) as back from cell")
def encode_sites(spark: SparkSession, sf: str) -> DataFrame:
    cells = al.canonical_cells(lineitem(spark, sf)).select("site", "taxon", "ch")
    coded = cells.withColumn("code", encode_state(F.col("ch")))
    return coded.withColumn("back", decode_state(F.col("code")))


@query(f"with {sqlgen.base()} select {CS}, w from pat")
def pattern_compress(spark: SparkSession, sf: str) -> DataFrame:
    return patterns(spark, sf)


@query(f"with {sqlgen.base()} select site, dense_rank() over (order by {CS}) as pattern_id from piv")
def pattern_map(spark: SparkSession, sf: str) -> DataFrame:
    return al.pattern_numbers(columns(spark, sf)).select("site", F.col("pattern_id").cast("long").alias("pattern_id"))


@query(f"with {sqlgen.base()} select cast((site + 2) % 3 as int) as partition, count(*) as sites, min(site) as first_site, max(site) as last_site from piv where site >= 1 group by 1")
def partition_bind(spark: SparkSession, sf: str) -> DataFrame:
    bound = al.bind_partitions(columns(spark, sf).select("site"), regions(spark, sf))
    return bound.groupBy("partition").agg(F.count("*").alias("sites"), F.min("site").alias("first_site"), F.max("site").alias("last_site"))


@query("""with s as (select distinct l_orderkey as site from lineitem), top as (select max(site) as hi from s),
r(lo, hi) as (select 1, hi // 2 from top union all select hi // 3, hi - 100 from top),
x as (select unnest(range(lo, hi + 1)) as site from r), t as (select site, count(*) as n from x group by site)
select count(*) filter (n > 1) as n_overlap, count(*) filter (n is null) as n_uncovered, count(*) filter (s.site is null) as n_outside
from s full join t on s.site = t.site""")
def partition_validate(spark: SparkSession, sf: str) -> DataFrame:
    sites = lineitem(spark, sf).select(F.col("l_orderkey").alias("site")).distinct()
    top = sites.agg(F.max("site").alias("hi"))
    bad = top.select(F.expr("explode(array(struct(0 as partition, 1L as lo, hi div 2 as hi, 1L as stride), struct(1 as partition, hi div 3 as lo, hi - 100 as hi, 1L as stride)))").alias("r")).select("r.*")
    return al.partition_problems(sites, bad)


@query(f"with {sqlgen.base()} select cast((site + 2) % 3 as int) as partition, {CS}, count(*) as w from piv where site >= 1 group by all")
def partition_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return al.compress(al.bind_partitions(columns(spark, sf), regions(spark, sf)), ["partition"])


@query("with " + sqlgen.base() + " select * from (" + " union all ".join(f"select {i} as taxon, count(*) filter (c{i} = 15) as gaps, count(*) as cells, round(count(*) filter (c{i} = 15) / count(*), 6) as share from piv" for i in range(1, 8)) + ")")
def gap_share(spark: SparkSession, sf: str) -> DataFrame:
    return al.gap_share(columns(spark, sf))


@query(f"with {sqlgen.base()} select site from piv where {' + '.join(f'cast(c{i} = 15 as int)' for i in range(1, 8))} >= 6")
def undetermined_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites that are undetermined in all taxa but one, or in all."""
    return al.undetermined_sites(columns(spark, sf), least=6).select("site")


def _frequency_sql() -> str:
    steps = ["code as (select code, sum(w) as n from (" + " union all ".join(f"select c{i} as code, w from pat" for i in range(1, 8)) + ") group by code)", "f0 as (select 0.25::double as a, 0.25::double as c, 0.25::double as g, 0.25::double as t)"]
    for r in range(8):
        total = "((code & 1) * a + (code >> 1 & 1) * c + (code >> 2 & 1) * g + (code >> 3 & 1) * t)"
        parts = ", ".join(f"sum(n * ((code >> {i} & 1) * {x}) / {total}) as {x}" for i, x in enumerate("acgt"))
        steps.append(f"s{r} as (select {parts} from code, f{r})")
        steps.append(f"f{r + 1} as (select a / (a + c + g + t) as a, c / (a + c + g + t) as c, g / (a + c + g + t) as g, t / (a + c + g + t) as t from s{r})")
    return with_base(steps, " union all ".join(f"select {i} as state, round({x}, 9) as freq from f8" for i, x in enumerate("acgt")))


@query(_frequency_sql())
def base_freq(spark: SparkSession, sf: str) -> DataFrame:
    return al.base_frequencies(patterns(spark, sf)).select("state", F.round("freq", 9).alias("freq"))


_RAW = (0.0, 0.0004, 0.3, 0.6996)


@query(" union all ".join(f"select {i} as state, round({x!r}, 9) as freq" for i, x in enumerate((0.001, 0.001, 0.3 * 0.998 / 0.9996, 0.6996 * 0.998 / 0.9996))))
def freq_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(float(x) for x in md.smooth_frequencies(_RAW))), "state int, freq double").select("state", F.round("freq", 9).alias("freq"))


def _distinct_sql(names: list[str]) -> str:
    return " + ".join(f"case when {' or '.join(f'{c} = {k}' for c in names)} then 1 else 0 end" for k in range(1, 15))


@query(f"with {sqlgen.base()} select {CS}, w, ({_distinct_sql(C)}) > 1 as informative from pat")
def informative_sites(spark: SparkSession, sf: str) -> DataFrame:
    return al.informative(patterns(spark, sf))


@query("""with a as (select distinct cast(l_linenumber as varchar) as taxon from lineitem), b as (select unnest(['2','3','4','5','6','7','8']) as taxon)
select coalesce(a.taxon, b.taxon) as taxon, a.taxon is not null as in_alignment, b.taxon is not null as in_tree from a full join b on a.taxon = b.taxon""")
def tip_join(spark: SparkSession, sf: str) -> DataFrame:
    names = lineitem(spark, sf).select(F.col("l_linenumber").cast("string").alias("taxon"))
    return al.join_tips(names, spark.createDataFrame([(str(i),) for i in range(2, 9)], "taxon string"))


_EXCLUDED = [(1, 500), (3000, 3100), (450, 700)]


@query(with_base([f"x as (select * from piv where not ({' or '.join(f'site between {a} and {b}' for a, b in _EXCLUDED)}))"], f"select {CS}, count(*) as w from x group by {CS}"))
def exclude_sites(spark: SparkSession, sf: str) -> DataFrame:
    ranges = spark.createDataFrame(_EXCLUDED, "lo long, hi long")
    return al.compress(al.exclude_sites(columns(spark, sf), ranges))


@query(with_base(["pc as (select x.taxon, cast(4 * x.k + y.k as int) as code from cell x join cell y on x.taxon = y.taxon and y.site = x.site + 1 where x.site % 2 = 0)"], "select cast(taxon as int) as taxon, code, count(*) as n from pc group by 1, 2"))
def paired_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each even site paired with the next one, as sixteen states."""
    cells = al.canonical_cells(lineitem(spark, sf))
    pairs = cells.where("site % 2 = 0").select(F.col("site").alias("a"), (F.col("site") + 1).alias("b")).distinct()
    return al.paired_states(cells, pairs).groupBy("taxon", "code").agg(F.count("*").alias("n"))


# files --------------------------------------------------------------------------------------------------------

#: Sites of one file.
FILE_SITES = 1 << 16


def _from_files(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The patterns of the alignment after it went through files of FILE_SITES sites each."""
    block = columns(spark, sf).withColumn("block", F.floor(F.col("site") / FILE_SITES)).groupBy("block")
    sites = block.agg(F.array_sort(F.collect_list(F.struct("site", *C))).alias("s"))  # FILE_SITES at most
    text = lambda c: F.array_join(F.transform("s", lambda x: decode_state(x[c])), "")
    rows = sites.select("block", F.explode(F.array(*[F.struct(F.lit(i).alias("taxon_id"), F.lit(f"t{i}").alias("taxon"), text(c).alias("seq")) for i, c in enumerate(C, 1)])).alias("r")).select("block", "r.*")
    path = readers.shared_folder(spark)
    readers.write_blocks(rows, path, kind)
    cells = al.cells_from_sequences(readers.read_alignment(spark, path, kind), by=["file"])
    coded = cells.select(F.struct("file", "site").alias("site"), F.col("taxon_id").alias("taxon"), F.coalesce("code", F.lit(15)).alias("code"))
    return al.compress(al.columns_from_cells(coded, range(1, 8)))


@query(f"with {sqlgen.base()} select {CS}, w from pat")
def phylip_files(spark: SparkSession, sf: str) -> DataFrame:
    return _from_files(spark, sf, "phylip")


@query(f"with {sqlgen.base()} select {CS}, w from pat")
def fasta_files(spark: SparkSession, sf: str) -> DataFrame:
    return _from_files(spark, sf, "fasta")


@query(f"with {sqlgen.base()} select cast(site % 2 as int) as ord, case when site % 2 = 1 then 'odd' else 'even' end as name, count(*) as sites, min(site) as first_site, max(site) as last_site from piv where site between 1 and 100000 group by all")
def partition_file(spark: SparkSession, sf: str) -> DataFrame:
    """Sites bound by the regions of a partition file."""
    path = readers.shared_folder(spark)
    text = "DNA, even = 2-100000/2\nASC_DNA, odd = 1-50000/2, 50001-100000/2\n"
    spark.createDataFrame([(text.rstrip(),)], "value string").coalesce(1).write.text(path)
    parts = readers.read_partitions(spark, path).select("ord", "name", F.explode("regions").alias("r"))
    regions = parts.select(F.struct("ord", "name").alias("partition"), F.col("r.start").cast("long").alias("lo"), F.col("r.end").cast("long").alias("hi"), F.col("r.stride").cast("long").alias("stride"))
    bound = al.bind_partitions(columns(spark, sf).select("site"), regions)
    return bound.groupBy("partition").agg(F.count("*").alias("sites"), F.min("site").alias("first_site"), F.max("site").alias("last_site")).select("partition.*", "sites", "first_site", "last_site")


# trees --------------------------------------------------------------------------------------------------------


def _edge_values(trees: list[tree.Tree]) -> str:
    rows = [(i, n, p, t.name.get(n), t.t(n, p) if p is not None else None) for i, t in enumerate(trees) for n, p in t.postorder()]
    q = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return "e(tree_id, node, parent, tip, t) as (values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


_INNER = max(TREE.inner_edges)


@query("with recursive " + _edge_values([TREE]) + f", s(node) as (select {_INNER[0]} union all select e.node from e join s on e.parent = s.node where e.node <> {_INNER[1]}) select cast(node as int) as node from s")
def subtree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    u, v = _INNER
    down = dict(TREE.postorder())
    nodes = _below(u) - (_below(v) if down[v] == u else set())
    return spark.createDataFrame([(n,) for n in sorted(nodes)], "node int")


def _below(node: int) -> set[int]:
    up = dict(TREE.postorder())
    return TREE.subtree(node, up[node]) if up[node] is not None else set(up)


@query("with " + _edge_values([TREE]) + " select least(a.node, a.parent) as u, greatest(a.node, a.parent) as v, round(cast(a.t as double), 6) as t from e a join e b on a.parent = b.node where a.tip is null and b.tip is null")
def inner_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.tree_rows(spark, [TREE])
    tips = rows.where("tip is not null").select(F.col("node").alias("n"))
    inner = rows.where("tip is null and parent is not null").join(tips, F.col("parent") == F.col("n"), "left_anti")
    return inner.select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), F.round("t", 6).alias("t"))


@query("""select distinct l_discount as d, round(greatest(1e-15, least(1 - 1e-6, exp(-l_discount / 1.25))), 12) as z,
round(-ln(greatest(1e-15, greatest(1e-15, least(1 - 1e-6, exp(-l_discount / 1.25))))) * 1.25, 9) as back,
round(greatest(1e-15, least(1 - 1e-6, pow(greatest(1e-15, least(1 - 1e-6, exp(-l_discount / 1.25))), 1.25 / 0.8))), 12) as moved
from (select distinct cast(l_discount as double) as l_discount from lineitem)""")
def branch_convert(spark: SparkSession, sf: str) -> DataFrame:
    d = al.table(spark, sf, "lineitem").select(F.col("l_discount").cast("double").alias("d")).distinct()
    z = d.withColumn("z", branch.length_to_z(F.col("d"), 1.25))
    return z.select("d", F.round("z", 12).alias("z"), F.round(branch.z_to_length(F.col("z"), 1.25), 9).alias("back"), F.round(branch.rescale(F.col("z"), 1.25, 0.8), 12).alias("moved"))


_TEXTS = [TEXT, "((1,2),(3,4));", "(1,(2,3,5),4);", "(a:1,b:2,(c,d):.5);"]


@query(" union all ".join(f"select {i} as tree_id, '{t}' as verdict, {n} as nodes, {k} as tips" for i, (t, n, k) in enumerate([("unrooted", 12, 7), ("rooted", 7, 4), ("bad", 7, 5), ("unrooted", 6, 4)])))
def newick_validate(spark: SparkSession, sf: str) -> DataFrame:
    nodes = splits.nodes_of_text(spark.createDataFrame(list(enumerate(_TEXTS)), "tree_id long, newick string"))
    shape = nodes.groupBy("tree_id").agg(F.count("*").cast("int").alias("nodes"), F.sum(F.col("is_tip").cast("int")).cast("int").alias("tips"), F.max(F.expr("if(parent_id < 0, rank, 0)")).alias("top"), F.max(F.expr("if(parent_id >= 0 and rank not in (0, 2), 1, 0)")).alias("odd"))
    return shape.select(F.col("tree_id").cast("int").alias("tree_id"), F.expr("case when odd = 1 or nodes < 4 then 'bad' when top = 3 then 'unrooted' when top = 2 then 'rooted' else 'bad' end").alias("verdict"), "nodes", "tips")


@query("with " + _edge_values([TREE]) + " select coalesce(e.parent, -1) as parent, count(*) as children from e where parent is not null group by 1")
def node_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tree_rows(spark, [TREE]).where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))


def _splits_sql(trees: list[tree.Tree]) -> list[str]:
    """Each node's tips by a recursive climb, then the side without tip 1."""
    return [
        _edge_values(trees),
        "up(tree_id, nd, tip) as (select tree_id, node, cast(tip as int) from e where tip is not null union all select e.tree_id, e.parent, up.tip from e join up on e.tree_id = up.tree_id and e.node = up.nd where e.parent is not null)",
        "m as (select u.tree_id, u.nd, bit_or(cast(1 as bigint) << (u.tip - 1)) as mask from up u join e on e.tree_id = u.tree_id and e.node = u.nd where e.parent is not null group by 1, 2)",
        "sp as (select distinct tree_id, case when mask & 1 = 1 then 127 - mask else mask end as split from m where bit_count(mask) between 2 and 5)",
    ]


@query("with recursive " + ",\n".join(_splits_sql(CANDIDATES)) + " select tree_id, split from sp")
def tree_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.splits(splits.tree_rows(spark, CANDIDATES)).select("tree_id", F.col("split")[0].alias("split"))


@query("with recursive " + ",\n".join(_splits_sql(CANDIDATES)) + """, n as (select tree_id, count(*) as n from sp group by 1),
c as (select x.tree_id as a, y.tree_id as b, count(*) as c from sp x join sp y on x.split = y.split and x.tree_id < y.tree_id group by 1, 2)
select p.tree_id as a, q.tree_id as b, p.n + q.n - 2 * coalesce(c.c, 0) as rf, (p.n + q.n - 2 * coalesce(c.c, 0)) / 8.0::double as rf_norm
from n p join n q on p.tree_id < q.tree_id left join c on c.a = p.tree_id and c.b = q.tree_id""")
def rf_distance(spark: SparkSession, sf: str) -> DataFrame:
    return splits.robinson_foulds(splits.splits(splits.tree_rows(spark, CANDIDATES)), 7)


@query("with recursive " + ",\n".join(_splits_sql(CANDIDATES)) + f" select split, count(*) as n, round(count(*) / {len(CANDIDATES)}.0::double, 6) as share from sp group by split")
def split_support(spark: SparkSession, sf: str) -> DataFrame:
    return splits.support(splits.splits(splits.tree_rows(spark, CANDIDATES)), len(CANDIDATES)).select(F.col("split")[0].alias("split"), "n", F.round("share", 6).alias("share"))


def _wide_splits_sql() -> str:
    return "with recursive " + ",\n".join([
        _edge_values(WIDE_TREES),
        "up(tree_id, nd, tip) as (select tree_id, node, cast(tip as int) from e where tip is not null union all select e.tree_id, e.parent, up.tip from e join up on e.tree_id = up.tree_id and e.node = up.nd where e.parent is not null)",
        "m as (select u.tree_id, u.nd, list(u.tip order by u.tip) as s from up u join e on e.tree_id = u.tree_id and e.node = u.nd where e.parent is not null group by 1, 2)",
        "sp as (select distinct tree_id, case when list_contains(s, 1) then list_filter(range(1, 81), lambda x: not list_contains(s, x)) else s end as split from m where len(s) between 2 and 78)",
    ])


@query(_wide_splits_sql() + """, n as (select tree_id, count(*) as n from sp group by 1),
c as (select x.tree_id as a, y.tree_id as b, count(*) as c from sp x join sp y on x.split = y.split and x.tree_id < y.tree_id group by 1, 2)
select p.tree_id as a, q.tree_id as b, p.n + q.n - 2 * coalesce(c.c, 0) as rf, (p.n + q.n - 2 * coalesce(c.c, 0)) / 154.0::double as rf_norm
from n p join n q on p.tree_id < q.tree_id left join c on c.a = p.tree_id and c.b = q.tree_id""")
def rf_distance_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of trees with 80 tips, parsed from their texts in tasks."""
    texts = spark.createDataFrame([(i, t.newick()) for i, t in enumerate(WIDE_TREES)], "tree_id int, newick string")
    return splits.robinson_foulds(splits.splits(splits.rows_of_text(texts)).withColumn("tree_id", F.col("tree_id").cast("int")), 80)


@query(_wide_splits_sql() + " select list_reduce(list_prepend(0::bigint, list_transform(split, lambda x: case when x <= 64 then 0::bigint else 1::bigint << (x - 65) end)), lambda a, b: a | b) as high, len(split) as size, count(*) as n from sp group by split")
def split_support_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Splits of trees with 80 tips: the second number of the bitmap, the number of tips, and how many trees have it."""
    found = splits.support(splits.splits(splits.tree_rows(spark, WIDE_TREES)), len(WIDE_TREES))
    return found.select(F.col("split")[1].alias("high"), F.expr("cast(bit_count(split[0]) + bit_count(split[1]) as long)").alias("size"), "n")


# likelihood ---------------------------------------------------------------------------------------------------

_JC_STEPS, _JC = sqlgen.site_lnl(TREE, JC4)
_GTR_STEPS, _GTR = sqlgen.site_lnl(TREE, GTR4)


@query(with_base(_JC_STEPS, f"select {CS}, w, round(lnl, 6) as lnl from {_JC}"))
def site_loglik(spark: SparkSession, sf: str) -> DataFrame:
    return lk.site_loglik(patterns(spark, sf), TREE, JC4).withColumn("lnl", F.round("lnl", 6))


@query(with_base(_JC_STEPS, f"select round(sum(w * lnl), 3) as lnl, cast(sum(w) as bigint) as sites, count(*) as patterns from {_JC}"))
def tree_loglik(spark: SparkSession, sf: str) -> DataFrame:
    each = lk.site_loglik(patterns(spark, sf), TREE, JC4)
    return each.agg(F.round(F.sum(F.col("w") * F.col("lnl")), 3).alias("lnl"), F.sum("w").alias("sites"), F.count("*").alias("patterns"))


@query(with_base(_GTR_STEPS, f"select round(sum(w * lnl), 3) as lnl, cast(sum(w) as bigint) as sites, count(*) as patterns from {_GTR}"))
def tree_loglik_arrow(spark: SparkSession, sf: str) -> DataFrame:
    each = lk.arrow_site_loglik(patterns(spark, sf), TREE, GTR4)
    return each.agg(F.round(F.sum(F.col("w") * F.col("lnl")), 3).alias("lnl"), F.sum("w").alias("sites"), F.count("*").alias("patterns"))


@query(with_base(_JC_STEPS, f"select site, round(lnl, 6) as lnl from piv join {_JC} using ({CS})"))
def site_loglik_by_site(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihoods of patterns carried back to their sites."""
    cols = columns(spark, sf)
    each = lk.site_loglik(al.compress(cols), TREE, JC4)
    return cols.join(each, C).select("site", F.round("lnl", 6).alias("lnl"))


_WIDE_CELL = f"wcell as (select l_orderkey as site, (l_linenumber - 1) * 7 + l_suppkey % 7 + 1 as taxon, min(l_partkey) % 4 as k from lineitem group by 1, 2), wpiv as (select site, " + ", ".join(f"coalesce(max(case when taxon = {i} then 1 << cast(k as int) end), 15) as c{i}" for i in range(1, WIDE_TAXA + 1)) + " from wcell group by site), wpat as (select " + ", ".join(f"c{i}" for i in range(1, WIDE_TAXA + 1)) + ", count(*) as w from wpiv group by all)"
_WIDE_STEPS, _WIDE_L = sqlgen.site_lnl(WIDE_TREE, GTR4, "wpat", ("w",), "wx")


def wide_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The line items as an alignment of 49 taxa: the line's number and the supplier's number modulo 7."""
    lines = al.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("site"), F.expr("cast((l_linenumber - 1) * 7 + l_suppkey % 7 + 1 as int)").alias("taxon"), "l_partkey")
    dealt = lines.repartition(al.tasks(spark), "site")  # both aggregations, by cell and by site, follow without another exchange
    rows = dealt.groupBy("site", "taxon").agg((F.min("l_partkey") % 4).cast("int").alias("k"))
    return al.compress_cells(rows.select("site", "taxon", F.expr("shiftleft(1, k)").alias("code")), range(1, WIDE_TAXA + 1))


@query("with " + ",\n".join([_WIDE_CELL, *_WIDE_STEPS]) + f" select round(sum(w * lnl), 3) as lnl, cast(sum(w) as bigint) as sites, count(*) as patterns from {_WIDE_L}")
def tree_loglik_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same entry on a tree whose columns are too many for expressions."""
    each = lk.site_loglik(wide_patterns(spark, sf), WIDE_TREE, GTR4)
    return each.agg(F.round(F.sum(F.col("w") * F.col("lnl")), 3).alias("lnl"), F.sum("w").alias("sites"), F.count("*").alias("patterns"))


_MIX = md.mixture([md.jc69(), md.f84((0.3, 0.2, 0.25, 0.25), 1.5), md.tn93((0.2, 0.3, 0.3, 0.2), 2.0, 4.0), GTR4], (0.2, 0.6, 1.1, 2.1), (0.1, 0.2, 0.3, 0.4))
_MIX_STEPS, _MIX_L = sqlgen.site_lnl(TREE, _MIX, "pat", ("w",), "x")


@query(with_base(_MIX_STEPS, f"select round(sum(w * lnl), 3) as lnl from {_MIX_L}"))
def mixture_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """One matrix per rate category, with free weights."""
    return lk.tree_loglik(patterns(spark, sf), TREE, _MIX).select(F.round("lnl", 3).alias("lnl"))


_AA = md.Model(tuple((i + 5) / 290 for i in range(20)), tuple(1.0 + (7 * i % 11) / 4 for i in range(190)), name="AA")
_AA_BASE = "acell as (select l_orderkey as site, l_linenumber as taxon, min(l_partkey) % 20 as k from lineitem group by 1, 2), apiv as (select site, " + ", ".join(f"coalesce(max(case when taxon = {i} then 1 << cast(k as int) end), {(1 << 20) - 1}) as c{i}" for i in range(1, 8)) + f" from acell group by site), apat as (select {CS}, count(*) as w from apiv group by {CS})"
_AA_STEPS, _AA_L = sqlgen.site_lnl(TREE, _AA, "apat", ("w",), "aa")


@query(f"with {_AA_BASE}, " + ", ".join(_AA_STEPS) + f" select round(sum(w * lnl), 3) as lnl, count(*) as patterns from {_AA_L}")
def amino_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty states: the line items read as residues."""
    low = [F.min(F.when(F.col("l_linenumber") == k, F.col("l_partkey"))).alias(f"k{k}") for k in range(1, 8)]
    cols = lineitem(spark, sf).groupBy("l_orderkey").agg(*low).select(*[F.coalesce((F.col(f"k{k}") % 20).cast("int"), F.lit(AMINO.undetermined)).alias(f"c{k}") for k in range(1, 8)])
    each = lk.arrow_site_loglik(al.compress(cols), TREE, _AA, AMINO)
    return each.agg(F.round(F.sum(F.col("w") * F.col("lnl")), 3).alias("lnl"), F.count("*").alias("patterns"))


_PAIR_STATES = 16
_S16 = secondary.paired_model("S16A", (1.5, 2.0, 0.8, 0.4, 1.0), [(i + 2) / 152 for i in range(16)])
_S16_BASE = "scell as (select x.site as a, x.taxon, 4 * x.k + y.k as k from cell x join cell y on x.taxon = y.taxon and y.site = x.site + 1 where x.site % 2 = 0), spiv as (select a, " + ", ".join(f"coalesce(max(case when taxon = {i} then 1 << cast(k as int) end), 65535) as c{i}" for i in range(1, 8)) + f" from scell group by a), spat as (select {CS}, count(*) as w from spiv group by {CS})"
_S16_STEPS, _S16_L = sqlgen.site_lnl(TREE, _S16, "spat", ("w",), "s16x")


@query(with_base([_S16_BASE, *_S16_STEPS], f"select round(sum(w * lnl), 3) as lnl, cast(sum(w) as bigint) as pairs from {_S16_L}"))
def paired_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """Even sites paired with the next one, under a sixteen-state model of paired sites."""
    cells = al.canonical_cells(lineitem(spark, sf))
    pairs = cells.where("site % 2 = 0").select(F.col("site").alias("a"), (F.col("site") + 1).alias("b")).distinct()
    coded = al.paired_states(cells, pairs).select(F.col("a").alias("site"), "taxon", "code")
    each = lk.arrow_site_loglik(al.compress(al.columns_from_cells(coded, range(1, 8), _PAIR_STATES)), TREE, _S16, secondary_alphabet(_PAIR_STATES))
    return each.agg(F.round(F.sum(F.col("w") * F.col("lnl")), 3).alias("lnl"), F.sum("w").alias("pairs"))


_PART_STEPS, _PART = sqlgen.site_lnl(TREE, GTR4, "pp", ("w", "partition"))
_PP = f"pp as (select cast((site + 2) % 3 as int) as partition, {CS}, count(*) as w from piv where site >= 1 group by all)"


@query(with_base([_PP, *_PART_STEPS], f"select partition, round(sum(w * lnl), 3) as lnl from {_PART} group by partition"))
def partition_loglik(spark: SparkSession, sf: str) -> DataFrame:
    parts = al.compress(al.bind_partitions(columns(spark, sf), regions(spark, sf)), ["partition"])
    return lk.tree_loglik(parts, TREE, GTR4, ["partition"]).select("partition", F.round("lnl", 3).alias("lnl"))


@query(with_base([_PP], "select partition, cast(sum(w) as bigint) as w, round(sum(w) / sum(sum(w)) over (), 9) as share from pp group by partition"))
def partition_shares(spark: SparkSession, sf: str) -> DataFrame:
    parts = al.bind_partitions(columns(spark, sf), regions(spark, sf)).groupBy("partition").agg(F.count("*").alias("w"))
    return parts.select("partition", "w", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 9).alias("share"))


_ASC = f"ac as (select {CS}, w, 0 as dummy from pat union all " + " union all ".join("select " + ", ".join([str(1 << s)] * 7) + ", 0, 1" for s in range(4)) + ")"
_ASC_STEPS, _ASC_L = sqlgen.site_lnl(TREE, GTR4, "ac", ("w", "dummy"))


@query(with_base([_ASC, *_ASC_STEPS], f"select round(sum(case when dummy = 0 then w * lnl else 0 end), 3) as lnl, round(sum(case when dummy = 1 then exp(lnl) else 0 end), 9) as p_constant, round(sum(case when dummy = 0 then w * lnl else 0 end) - sum(w) * ln(1 - sum(case when dummy = 1 then exp(lnl) else 0 end)), 3) as lnl_corrected from {_ASC_L}"))
def loglik_asc(spark: SparkSession, sf: str) -> DataFrame:
    out = lk.corrected_for_invariant(patterns(spark, sf), TREE, GTR4)
    return out.select(F.round("lnl", 3).alias("lnl"), F.round("p_constant", 9).alias("p_constant"), F.round("lnl_corrected", 3).alias("lnl_corrected"))


def _psr_sql() -> str:
    steps = [f"pc as (select cast(site % 3 as int) as category, {CS}, count(*) as w from piv group by all)"]
    parts = []
    for k, r in enumerate(PSR_RATES):
        steps.append(f"pc{k} as (select * from pc where category = {k})")
        made, last = sqlgen.site_lnl(TREE, md.jc69((r,)), f"pc{k}", ("w", "category"), f"q{k}x")
        steps += made
        parts.append(f"select category, cast(sum(w) as bigint) as n, round(sum(w * lnl), 3) as lnl from {last} group by category")
    return with_base(steps, " union all ".join(parts))


@query(_psr_sql())
def loglik_psr(spark: SparkSession, sf: str) -> DataFrame:
    cols = columns(spark, sf).withColumn("category", (F.col("site") % 3).cast("int"))
    out = lk.loglik_by_category(al.compress(cols, ["category"]), TREE, md.jc69(), "category", PSR_RATES)
    return out.select("category", "n", F.round("lnl", 3).alias("lnl"))


_EDGE = TREE.inner_edges[0]


def _derivative_sql() -> str:
    steps, last = sqlgen.site_slopes(TREE, GTR4, _EDGE)
    return with_base(steps, f"select round(sum(w * x1 / x0), 3) as d1, round(sum(w * (x2 / x0 - x1 / x0 * x1 / x0)), 3) as d2 from {last}")


@query(_derivative_sql())
def branch_derivs(spark: SparkSession, sf: str) -> DataFrame:
    d1, d2 = lk.edge_derivatives(patterns(spark, sf), TREE, GTR4)[_EDGE]
    return spark.createDataFrame([(d1, d2)], "d1 double, d2 double").select(F.round("d1", 3).alias("d1"), F.round("d2", 3).alias("d2"))


def _asc_derivative_sql() -> str:
    steps, last = sqlgen.site_slopes(TREE, GTR4, _EDGE, "ac", ("w", "dummy"))
    sums = "sum(case when dummy = 0 then w * x1 / x0 end) as d1, sum(case when dummy = 0 then w * (x2 / x0 - x1 / x0 * x1 / x0) end) as d2, sum(w) as n, " + ", ".join(f"sum(case when dummy = 1 then x{i} end) as p{i}" for i in range(3))
    return with_base([_ASC, *steps, f"z as (select {sums} from {last})"], "select round(d1 + n * p1 / (1 - p0), 3) as d1, round(d2 + n * (p2 / (1 - p0) + pow(p1 / (1 - p0), 2)), 3) as d2 from z")


@query(_asc_derivative_sql())
def asc_derivs(spark: SparkSession, sf: str) -> DataFrame:
    """Derivatives of the log-likelihood that is corrected for missing constant columns."""
    d1, d2 = lk.corrected_derivatives(patterns(spark, sf), TREE, GTR4)[_EDGE]
    return spark.createDataFrame([(d1, d2)], "d1 double, d2 double").select(F.round("d1", 3).alias("d1"), F.round("d2", 3).alias("d2"))


_NODE = _EDGE[0]


def _ancestral_sql() -> str:
    steps, last, cols = sqlgen.node_steps(TREE, GTR4, "pat", ("w",), root=_NODE, tag="a")
    w = GTR4.category_weights
    raw = [" + ".join(f"{sqlgen.number(w[r] * GTR4.freqs[s])} * {row[s]}" for r, row in enumerate(cols)) for s in range(4)]
    steps.append(f"ar as (select {CS}, w, {', '.join(f'{x} as r{s}' for s, x in enumerate(raw))} from {last})")
    steps.append(f"ap as (select {CS}, w, {', '.join(f'r{s} / (r0 + r1 + r2 + r3) as p{s}' for s in range(4))} from ar)")
    best = "case when greatest(abs(p0 - 0.25), abs(p1 - 0.25), abs(p2 - 0.25), abs(p3 - 0.25)) < 1e-6 then '?' " + " ".join(f"when p{s} >= greatest(p0, p1, p2, p3) then '{c}'" for s, c in enumerate("ACGT")) + " end"
    return with_base(steps, f"select {CS}, w, {', '.join(f'round(p{s}, 6) as p{s}' for s in range(4))}, {best} as ch from ap")


@query(_ancestral_sql())
def ancestral_state(spark: SparkSession, sf: str) -> DataFrame:
    out = lk.ancestral(patterns(spark, sf), TREE, GTR4, _NODE)
    return out.select(*C, "w", *[F.round(f"p{s}", 6).alias(f"p{s}") for s in range(4)], "ch")


def _many_sql(trees: list[tree.Tree], mod: md.Model, names: list[str]) -> str:
    steps, parts = [], []
    for i, t in enumerate(trees):
        made, last = sqlgen.site_lnl(t, mod, "pat", ("w",), f"k{i}x")
        steps += made
        parts.append(f"select {names[i]}, (select sum(w * lnl) from {last}) as lnl")
    return with_base([*steps, "al as (" + " union all ".join(parts) + ")"], "")


@query(_many_sql(CANDIDATES, JC4, [f"{i} as tree_id" for i in range(len(CANDIDATES))]) + "select tree_id, round(lnl, 3) as lnl, cast(row_number() over (order by lnl desc, tree_id) as int) as rank from al qualify row_number() over (order by lnl desc, tree_id) <= 4")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    got = lk.loglik_many(patterns(spark, sf), [(t, JC4) for t in CANDIDATES])
    rows = spark.createDataFrame(list(enumerate(got)), "tree_id int, lnl double").orderBy(F.desc("lnl"), "tree_id").limit(4)
    return rows.select("tree_id", F.round("lnl", 3).alias("lnl"), F.row_number().over(Window.orderBy(F.desc("lnl"), "tree_id")).alias("rank"))


_NNI = search.nni_moves(TREE)


@query(_many_sql([m.tree for m in _NNI], JC4, [f"{m.place[0][0]} as u, {m.place[0][1]} as v, {m.place[1]} as which" for m in _NNI]) + "select u, v, which, round(lnl, 3) as lnl from al")
def nni_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = lk.loglik_many(patterns(spark, sf), [(m.tree, JC4) for m in _NNI])
    rows = [(*m.place[0], m.place[1], x) for m, x in zip(_NNI, got, strict=True)]
    return spark.createDataFrame(rows, "u int, v int, which int, lnl double").withColumn("lnl", F.round("lnl", 3))


_SPR = search.spr_moves(TREE, 1, 2)


@query(_many_sql([m.tree for m in _SPR], JC4, [f"{i} as move" for i in range(len(_SPR))]) + "select move, round(lnl, 3) as lnl from al")
def spr_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = lk.loglik_many(patterns(spark, sf), [(m.tree, JC4) for m in _SPR])
    return spark.createDataFrame(list(enumerate(got)), "move int, lnl double").withColumn("lnl", F.round("lnl", 3))


# parsimony ----------------------------------------------------------------------------------------------------

_F_STEPS, _F = sqlgen.fitch(TREE)


@query(with_base(_F_STEPS, f"select cast(sum(w * changes) as bigint) as score from {_F}"))
def parsimony_score(spark: SparkSession, sf: str) -> DataFrame:
    return parsimony.score(patterns(spark, sf), TREE)


@query(with_base(_F_STEPS, f"select {CS}, w, cast(changes as int) as changes from {_F}"))
def parsimony_site(spark: SparkSession, sf: str) -> DataFrame:
    return parsimony.fitch_fold(patterns(spark, sf), TREE)


def _rank_sql() -> str:
    steps, parts = [], []
    for i, t in enumerate(CANDIDATES):
        made, last = sqlgen.fitch(t, tag=f"k{i}x")
        steps += made
        parts.append(f"select {i} as tree_id, (select cast(sum(w * changes) as bigint) from {last}) as score")
    return with_base([*steps, "al as (" + " union all ".join(parts) + ")"], "select tree_id, score, cast(row_number() over (order by score, tree_id) as int) as rank from al")


@query(_rank_sql())
def parsimony_rank(spark: SparkSession, sf: str) -> DataFrame:
    got = parsimony.scores(patterns(spark, sf), CANDIDATES)
    return spark.createDataFrame(list(enumerate(got)), "tree_id int, score long").withColumn("rank", F.row_number().over(Window.orderBy("score", "tree_id")))


# alignment scores ---------------------------------------------------------------------------------------------

_PAIRS = "l as (select site, k, count(*) as n from cell group by 1, 2), pr as (select site, sum(n * (n - 1) // 2) as same, sum(n) as n from l group by site), pp2 as (select site, same, n * (n - 1) // 2 as pairs from pr)"


@query(with_base([_PAIRS], "select site, cast(same as bigint) as same, cast(pairs as bigint) as pairs from pp2"))
def sp_columns(spark: SparkSession, sf: str) -> DataFrame:
    return msa.pair_counts(al.canonical_cells(lineitem(spark, sf)))


@query(with_base([_PAIRS], "select cast(sum(same) as bigint) as same, cast(sum(pairs) - sum(same) as bigint) as different, cast(sum(pairs) as bigint) as pairs, round(sum(same) / sum(pairs), 6) as similarity, round((sum(pairs) - sum(same)) / sum(pairs), 6) as distance from pp2"))
def sum_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return msa.sum_of_pairs(al.canonical_cells(lineitem(spark, sf)))


def _letters(width: str) -> str:
    return f"select site, string_agg(substr('ACGT', cast(k as int) + 1, 1), '' order by taxon) as col from cell where {width} group by site"


@query(with_base([f"p as ({_letters('site % 5 <> 0')})", f"r as ({_letters('true')})", "pc as (select col, count(*) as p from p group by 1)", "rc as (select col, count(*) as r from r group by 1)"], "select cast(sum(least(r, coalesce(p, 0))) as bigint) as matched, cast(sum(r) as bigint) as total, round(sum(least(r, coalesce(p, 0))) / sum(r), 6) as score from rc left join pc using (col)"))
def tc_score(spark: SparkSession, sf: str) -> DataFrame:
    """The columns against themselves without every fifth one."""
    cells = al.canonical_cells(lineitem(spark, sf))
    return msa.total_column(msa.column_texts(cells.where("site % 5 <> 0")), msa.column_texts(cells))


_MOVED = "case when taxon = 3 then site + 1 else site end"


def _confusion_sql() -> str:
    def pairs(name: str, site: str) -> list[str]:
        return [
            f"{name}n as (select {site} as site, taxon, row_number() over (partition by taxon order by {site}) as i from cell)",
            f"{name}p as (select x.taxon as a, y.taxon as b, x.i as i, y.i as j from {name}n x join {name}n y on x.site = y.site and x.taxon < y.taxon)",
        ]

    steps = [*pairs("p", _MOVED), *pairs("r", "site"), "k as (select count(*) filter (p.a is not null and r.a is not null) as tp, count(*) filter (r.a is null) as fp, count(*) filter (p.a is null) as fn from pp p full join rp r on p.a = r.a and p.b = r.b and p.i = r.i and p.j = r.j)", "f as (select *, 1000000000 - tp - fp - fn as tn from k)"]
    return with_base(steps, "select tp, fp, fn, cast(tn as bigint) as tn, round(tp / (tp + fn), 6) as sensitivity, round(tp / (tp + fp), 6) as selectivity, round((tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from f")


@query(_confusion_sql())
def pair_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Residue pairs of all taxa against those after the third one slid by a column."""
    cells = al.canonical_cells(lineitem(spark, sf)).select("site", "taxon", "ch")
    moved = cells.withColumn("site", F.expr(_MOVED))
    return msa.confusion(msa.residue_pairs(moved), msa.residue_pairs(cells), 1_000_000_000)


@query(with_base([], " union all ".join(f"select {i} as a, {j} as b, cast(coalesce(sum(case when c{i} < 15 and c{i} = c{j} then w end), 0) as bigint) as same, cast(coalesce(sum(case when c{i} < 15 and c{j} < 15 then w end), 0) as bigint) as cells, round(coalesce(sum(case when c{i} < 15 and c{i} = c{j} then w end), 0) / sum(case when c{i} < 15 and c{j} < 15 then w end), 6) as identity from pat" for i in range(1, 8) for j in range(i + 1, 8))))
def pair_identity(spark: SparkSession, sf: str) -> DataFrame:
    return msa.pair_identity(patterns(spark, sf))


# models -------------------------------------------------------------------------------------------------------

_TS = (0.01, 0.1, 0.5, 2.0)
_F81 = (0.4, 0.3, 0.2, 0.1)


def _f81_sql() -> str:
    beta = 1 / (1 - sum(f * f for f in _F81))
    parts = [f"select cast({t!r} as double) as t, {i} as i, {j} as j, round({f!r} * (1 - exp(-{beta!r} * {t!r})){f' + exp(-{beta!r} * {t!r})' if i == j else ''}, 9) as p" for t in _TS for i in range(4) for j, f in enumerate(_F81)]
    return " union all ".join(parts)


@query(_f81_sql())
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = md.Model(_F81, (1.0,) * 6)
    rows = [(t, i, j, float(m.p(t)[i, j])) for t in _TS for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "t double, i int, j int, p double").withColumn("p", F.round("p", 9))


@query(""" with q as (select unnest(range(0, 4)) as k), c as (select k, case when k = 0 then 0 else -ln(1 - k / 4.0) end as lo, case when k = 3 then null else -ln(1 - (k + 1) / 4.0) end as hi from q)
select cast(k as int) as category, round(4 * ((1 - coalesce(exp(-hi) * (1 + hi), 0)) - (1 - exp(-lo) * (1 + lo))), 9) as rate from c""")
def gamma_categories(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(gamma_rates(1.0, 4))], "category int, rate double").withColumn("rate", F.round("rate", 9))


@query("""with x as (select distinct cast(l_discount as double) + 0.01 as t from lineitem), y as (select t, 0.8 * t as x, exp(-0.8 * t) as e, 6 * (1 + 0.8 * t) as g, 1 - exp(-0.8 * t) as lost from x)
select round(t, 6) as t, round(1 - (1 + x - e) / g, 9) as p_h_h, round(lost / g, 9) as p_h_d, round(x / g, 9) as p_h_i, round(x * e / (g * lost), 9) as p_d_h, round(1 - 1 / g, 9) as p_d_d,
round((1 - e * (1 + x)) / (g * lost), 9) as p_d_i, round(e / g, 9) as p_i_h, round(lost / g, 9) as p_i_d, round(1 - 1 / g, 9) as p_i_i from y""")
def fid_matrix(spark: SparkSession, sf: str) -> DataFrame:
    t = al.table(spark, sf, "lineitem").select((F.col("l_discount").cast("double") + 0.01).alias("t")).distinct()
    out = t.select("t", *statalign.fid_columns(F.lit(0.8), F.lit(6.0), F.col("t")))
    return out.select(*[F.round(c, 6 if c == "t" else 9).alias(c) for c in out.columns])


_MODELS = {"JC": (md.jc69(), 0), "JC+G": (md.jc69().with_alpha(0.7), 1), "F81": (md.Model(_F81, (1.0,) * 6), 3), "GTR+G": (GTR4, 9)}


def _select_sql() -> str:
    steps, parts = [], []
    for i, (name, (m, k)) in enumerate(_MODELS.items()):
        made, last = sqlgen.site_lnl(TREE, m, "pat", ("w",), f"k{i}x")
        steps += made
        parts.append(f"select '{name}' as model, {k} as k, (select sum(w * lnl) from {last}) as lnl, (select sum(w) from pat) as n")
    steps.append("al as (" + " union all ".join(parts) + ")")
    return with_base(steps, "select model, k, round(lnl, 3) as lnl, round(2 * k - 2 * lnl, 3) as aic, round(2 * k - 2 * lnl + 2.0 * k * (k + 1) / (n - k - 1), 3) as aicc, round(k * ln(n) - 2 * lnl, 3) as bic, k * ln(n) - 2 * lnl = min(k * ln(n) - 2 * lnl) over () as best from al")


@query(_select_sql())
def model_select(spark: SparkSession, sf: str) -> DataFrame:
    p = patterns(spark, sf)
    best, table = optimize.select_model(p, TREE, _MODELS, p.agg(F.sum("w")).first()[0])
    rows = [(n, _MODELS[n][1], t["lnl"], t["aic"], t["aicc"], t["bic"], n == best) for n, t in table.items()]
    return spark.createDataFrame(rows, "model string, k int, lnl double, aic double, aicc double, bic double, best boolean").select("model", "k", *[F.round(c, 3).alias(c) for c in ("lnl", "aic", "aicc", "bic")], "best")


# searches and samplers: no SQL --------------------------------------------------------------------------------


_GRID = [2.0 ** (k / 2) for k in range(-8, 7)]


def _site_rate_sql() -> str:
    steps, parts = [], []
    for k, r in enumerate(_GRID):
        made, last = sqlgen.site_lnl(TREE, md.jc69((r,)), "pat", ("w",), f"r{k}x")
        steps += made
        parts.append(f"select {CS}, w, {sqlgen.number(r)} as r, lnl from {last}")
    steps += [
        "al as (" + " union all ".join(parts) + ")",
        f"tops as (select *, max(lnl) over (partition by {CS}) as most from al)",
        f"best as (select w, round(r, 3) as rate, lnl from tops where lnl >= most - 1e-9 qualify row_number() over (partition by {CS} order by r) = 1)",
        "sums as (select rate, sum(w) as n, sum(w * lnl) as lnl from best group by rate)",
        "kept as (select rate as k from sums order by lnl, rate limit 8)",
        "near as (select n, lnl, k from sums, kept qualify row_number() over (partition by rate order by abs(k - rate), k) = 1)",
        "grp as (select k as rate, sum(n) as n, sum(lnl) as lnl from near group by k)",
    ]
    return with_base(steps, "select cast(row_number() over (order by rate) - 1 as int) as category, round(rate * sum(n) over () / sum(n * rate) over (), 6) as rate, cast(n as bigint) as n, round(lnl, 3) as lnl from grp")


@query(_site_rate_sql())
def site_rates(spark: SparkSession, sf: str) -> DataFrame:
    """One rate per site: the best of a grid, grouped to at most eight categories."""
    rated = lk.best_rates(patterns(spark, sf), TREE, md.jc69(), _GRID)
    out = lk.rate_categories(rated, 8)
    return out.select("category", F.round("rate", 6).alias("rate"), "n", F.round("lnl", 3).alias("lnl"))


@query()
def site_rates_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by line search, grouped, against one rate for all sites."""
    p = patterns(spark, sf)
    before = [1.0], lk.loglik_many(p, [(TREE, md.jc69())])[0]
    rates, lnl, better = lk.optimise_site_rates(p, TREE, md.jc69(), _GRID, 8, 3, before)
    return spark.createDataFrame([(k, r, lnl, better) for k, r in enumerate(rates)], "category int, rate double, lnl double, better boolean").select("category", F.round("rate", 6).alias("rate"), F.round("lnl", 3).alias("lnl"), "better")


@query()
def newton_branch(spark: SparkSession, sf: str) -> DataFrame:
    p = kept_patterns(spark, sf)
    fitted, lnl = optimize.newton_lengths(p, TREE, JC4)
    p.unpersist()
    return spark.createDataFrame([(u, v, t, lnl) for (u, v), t in fitted.length.items()], "u int, v int, t double, lnl double").select("u", "v", F.round("t", 4).alias("t"), F.round("lnl", 2).alias("lnl"))


@query()
def optimise_alpha(spark: SparkSession, sf: str) -> DataFrame:
    p = kept_patterns(spark, sf)
    m, lnl = optimize.optimise_alpha(p, TREE, md.jc69().with_alpha(1.0))
    p.unpersist()
    return spark.createDataFrame([(m.alpha, lnl)], "alpha double, lnl double").select(F.round("alpha", 4).alias("alpha"), F.round("lnl", 2).alias("lnl"))


@query()
def optimise_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Transition against transversion rates by a symmetry string."""
    p = kept_patterns(spark, sf)
    m, lnl = optimize.optimise_rates(p, TREE, replace(md.jc69(), name="HKY"), "0,1,0,0,1,0", 1)
    p.unpersist()
    return spark.createDataFrame([(float(m.rates[1] / m.rates[0]), lnl)], "ratio double, lnl double").select(F.round("ratio", 4).alias("ratio"), F.round("lnl", 2).alias("lnl"))


@query()
def nni_search(spark: SparkSession, sf: str) -> DataFrame:
    p = kept_patterns(spark, sf)
    best, lnl, n = search.nni_search(p, CANDIDATES[1], md.jc69())
    p.unpersist()
    return spark.createDataFrame([(",".join(map(str, best.canonical())), lnl, n)], "topology string, lnl double, moves int").withColumn("lnl", F.round("lnl", 2))


@query()
def spr_search(spark: SparkSession, sf: str) -> DataFrame:
    p = kept_patterns(spark, sf)
    best, lnl, n = search.spr_search(p, CANDIDATES[2], md.jc69(), 3, thorough=1)
    p.unpersist()
    return spark.createDataFrame([(",".join(map(str, best.canonical())), lnl, n)], "topology string, lnl double, moves int").withColumn("lnl", F.round("lnl", 2))


@query()
def rapid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Subtree moves by rings with a cutoff and a list of starts."""
    p = kept_patterns(spark, sf)
    best, lnl, n = search.rapid_search(p, CANDIDATES[2], md.jc69(), 3)
    p.unpersist()
    return spark.createDataFrame([(",".join(map(str, best.canonical())), lnl, n)], "topology string, lnl double, moves int").withColumn("lnl", F.round("lnl", 2))


@query()
def ml_search(spark: SparkSession, sf: str) -> DataFrame:
    """The full search from a parsimony tree: swaps, then subtree moves; the best topologies it met."""
    p = kept_patterns(spark, sf)
    start, _ = parsimony.stepwise_addition(p, [str(i) for i in range(1, 8)], seed=1)
    _, _, best = search.ml_search(p, start, md.jc69(), 3)
    rows = [(k, *best.recall(k)) for k in range(1, len(best.rows) + 1)]
    p.unpersist()
    return spark.createDataFrame([(k, ",".join(map(str, t.canonical())), lnl) for k, t, lnl in rows], "rank int, topology string, lnl double").withColumn("lnl", F.round("lnl", 2))


_TBR = search.tbr_moves(TREE, 2)


@query(_many_sql([m.tree for m in _TBR], JC4, [f"'{','.join(map(str, m.tree.canonical()))}' as topology" for m in _TBR]) + "select topology, round(lnl, 3) as lnl from al")
def tbr_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All trees that one cut and one new joint within two edges give."""
    moves = search.scored(patterns(spark, sf), _TBR, JC4)
    return spark.createDataFrame([(",".join(map(str, m.tree.canonical())), m.lnl) for m in moves], "topology string, lnl double").withColumn("lnl", F.round("lnl", 3))


@query()
def parsimony_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Stepwise addition, then subtree moves until the score stands still."""
    p = patterns(spark, sf)
    start, first = parsimony.stepwise_addition(p, [str(i) for i in range(1, 8)])
    best, score = parsimony.spr_improve(p, start)
    return spark.createDataFrame([(first, score, ",".join(map(str, best.canonical())))], "start_score long, score long, topology string")


@query()
def sample_trees(spark: SparkSession, sf: str) -> DataFrame:
    out = mcmc.sample(patterns(spark, sf), TREE, md.jc69().with_alpha(1.0), 4, 100, 50)
    return out.select("chain", "step", F.round("lnl", 3).alias("lnl"), F.round("accepted", 6).alias("accepted"), F.round("alpha", 6).alias("alpha"), F.round("tree_length", 6).alias("tree_length"), "topology")


@query()
def align_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of sixteen order keys: the sequences of the first two taxa aligned under one ancestor."""
    cells = al.canonical_cells(lineitem(spark, sf)).where("taxon <= 2").withColumn("region", F.expr("cast(floor(site / 16) as long)")).repartition(al.tasks(spark), "region")  # few bytes, much work
    seqs = cells.groupBy("region", "taxon").agg(F.expr("array_join(transform(array_sort(collect_list(struct(site, ch))), x -> x.ch), '')").alias("seq"))
    pairs = seqs.groupBy("region").agg(F.expr("transform(array_sort(collect_list(struct(taxon, seq))), x -> x.seq)").alias("seqs")).where("size(seqs) = 2")
    out = statalign.align_regions(pairs, md.jc69(), 0.2, 2.0, (0.3, 0.5), samples=2)
    return out.select("region", F.round("logp", 6).alias("logp"), "best", "sampled")


@query()
def align_all_taxa(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of sixteen order keys: the sequences of all seven taxa aligned up the tree."""
    cells = al.canonical_cells(lineitem(spark, sf)).withColumn("region", F.expr("cast(floor(site / 16) as long)")).repartition(al.tasks(spark), "region")  # few bytes, much work
    seqs = cells.groupBy("region", F.col("taxon").cast("string").alias("taxon")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(site, ch))), x -> x.ch), '')").alias("seq"))
    both = seqs.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("taxon", "seq"))).alias("m"))
    return statalign.align_trees(both.select("region", F.expr("m.taxon").alias("names"), F.expr("m.seq").alias("seqs")), md.jc69(), 0.2, 2.0, TREE).select("region", F.array_join("rows", "|").alias("rows"))
