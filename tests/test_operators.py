import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.functions.alphabet import AMINO, BINARY, DNA
from cladespark.functions.special import gamma_rates
from cladespark.operators import alignment as al
from cladespark.operators import likelihood as lk
from cladespark.operators import mcmc, optimize, parsimony, search, splits, statalign
from cladespark.plans import model as md
from cladespark.plans import tree as tr

TREE = tr.parse("(5:0.1,(4:0.2,(2:0.3,(7:0.15,(3:0.1,6:0.2):0.05):0.1):0.12):0.08,1:0.25);")
GTR = md.Model((0.3, 0.2, 0.25, 0.25), (1.2, 3.1, 0.8, 0.9, 3.4, 1.0)).with_alpha(0.7)


@pytest.fixture(scope="module")
def columns(spark):
    rng = random.Random(5)
    base = [rng.choice([1, 2, 4, 8]) for _ in range(60)]
    rows = [(i + 1, *[b if rng.random() < 0.8 else rng.choice([1, 2, 4, 8, 15, 5]) for _ in range(7)]) for i, b in enumerate(base)]
    return spark.createDataFrame(rows, "site int, " + ", ".join(f"c{k} int" for k in range(1, 8)))


@pytest.fixture(scope="module")
def patterns(columns):
    return al.compress(columns).cache()


def brute_lnl(codes, tree, model):
    """Sum over all states of the inner nodes."""
    inner = [n for n in tree.near if not tree.is_tip(n)]
    total = 0.0
    for r, rate in enumerate(model.site_rates):
        p = {e: model.p(t, rate) for e, t in tree.length.items()}
        down = dict(tree.postorder())
        for states in itertools.product(range(model.states), repeat=len(inner)):
            at = dict(zip(inner, states))
            x = model.freqs[at[tree.root]]
            for node, parent in down.items():
                if parent is None:
                    continue
                row = p[min(node, parent), max(node, parent)][at[parent]]
                x *= row[at[node]] if node in at else sum(row[s] for s in range(4) if codes[int(tree.name[node]) - 1] >> s & 1)
            total += model.category_weights[r] * x
    return math.log(total)


def test_both_evaluators_agree_with_brute_force(patterns):
    rows = lk.site_loglik(patterns, TREE, GTR).collect()
    other = {tuple(r.states): r.lnl for r in lk.arrow_site_loglik(patterns, TREE, GTR).collect()}
    for r in rows[:6]:
        codes = [r[f"c{k}"] for k in range(1, 8)]
        assert math.isclose(r.lnl, brute_lnl(codes, TREE, GTR), rel_tol=1e-9)
    for r in rows:
        assert math.isclose(r.lnl, other[tuple(r[f"c{k}"] for k in range(1, 8))], rel_tol=1e-9)


def test_root_and_compression_do_not_matter(patterns, columns):
    a = lk.tree_loglik(patterns, TREE, GTR).first().lnl
    b = lk.tree_loglik(columns.withColumn("w", F.lit(1)), TREE, GTR).first().lnl
    assert math.isclose(a, b, rel_tol=1e-9)
    df, have = lk.node_columns(patterns, TREE, GTR, ("w",), root=max(TREE.near))
    c = df.select(F.sum(F.col("w") * F.log(lk.site_likelihood(GTR, have[max(TREE.near)])))).first()[0]
    assert math.isclose(a, c, rel_tol=1e-9)
    assert patterns.agg(F.sum("w")).first()[0] == columns.count()


def test_derivatives(patterns):
    got = lk.edge_derivatives(patterns, TREE, GTR)
    for e in TREE.edges:
        h = 1e-4
        x = lk.loglik_many(patterns, [(TREE.with_lengths({e: TREE.length[e] + d}), GTR) for d in (-h, 0, h)])
        assert math.isclose(got[e][0], (x[2] - x[0]) / (2 * h), rel_tol=1e-3, abs_tol=1e-3)
        assert math.isclose(got[e][1], (x[2] - 2 * x[1] + x[0]) / h**2, rel_tol=1e-2, abs_tol=0.5)


def test_underflow_and_many_taxa():
    names = [str(i) for i in range(1, 401)]
    t = tr.random_tree(names, 7, 0.4)
    codes = np.array([[1 << (i * k % 4) for i in range(400)] for k in range(1, 4)])
    assert np.isfinite(lk.Kernel(t, md.jc69()).lnl(codes)).all() and (lk.Kernel(t, md.jc69()).lnl(codes) < -400).all()


def test_amino_acids_and_binary(spark):
    seqs = spark.createDataFrame([(1, "a", "ARNDB-"), (2, "b", "ARNEZX"), (3, "c", "CRND*?")], "taxon_id int, taxon string, seq string")
    cells = al.cells_from_sequences(seqs, AMINO)
    assert cells.where("code is null").count() == 0
    cols = al.columns_from_cells(cells.select("site", F.col("taxon_id").alias("taxon"), "code"), [1, 2, 3], 22)
    got = lk.arrow_site_loglik(al.compress(cols), tr.star(["1", "2", "3"]), md.equal(20), AMINO).collect()
    assert len(got) == 6 and all(r.lnl < 0 or set(r.states) == {22} for r in got)
    assert al.cells_from_sequences(seqs, BINARY).where("code is not null").count() == 2 + 0


def test_mixture_weights(patterns):
    parts = [md.jc69(), md.Model((0.3, 0.2, 0.25, 0.25), (1, 2, 1, 1, 2, 1.0))]
    m = md.mixture(parts, (0.5, 1.5), (0.4, 0.6))
    codes = np.array([[1, 1, 2, 4, 8, 15, 1]])
    each = [math.exp(lk.Kernel(TREE, md.Model(p.freqs, p.rates, (r,))).lnl(codes)[0]) for p, r in zip(parts, (0.5, 1.5))]
    assert math.isclose(lk.Kernel(TREE, m).lnl(codes)[0], math.log(0.4 * each[0] + 0.6 * each[1]), rel_tol=1e-9)


def test_optimisers_never_lose(patterns):
    start = lk.loglik_many(patterns, [(TREE, md.jc69())])[0]
    t, lnl = optimize.newton_lengths(patterns, TREE, md.jc69(), 0.01, 6)
    assert lnl >= start and math.isclose(lk.loglik_many(patterns, [(t, md.jc69())])[0], lnl, rel_tol=1e-9)


def test_two_sequence_distance(spark):
    """The fitted length of the path between two taxa is the closed form of the equal-rates model."""
    rows = spark.createDataFrame([(1, 1, 15, 70), (1, 2, 15, 20), (2, 2, 15, 10)], "c1 int, c2 int, c3 int, w int")
    t, _ = optimize.newton_lengths(rows, tr.star(["1", "2", "3"]), md.jc69(), 1e-7, 40)
    got = sum(x for e, x in t.length.items() if 3 not in e)
    assert math.isclose(got, -0.75 * math.log(1 - 4 / 3 * 0.2), rel_tol=1e-2)


def fitch(codes, tree):
    have, n = {}, 0
    for node, parent in tree.postorder():
        if tree.is_tip(node):
            have[node] = codes[int(tree.name[node]) - 1]
            continue
        kids = [have[k] for k in tree.near[node] if k != parent]
        x = kids[0]
        for y in kids[1:]:
            if x & y:
                x &= y
            else:
                x, n = x | y, n + 1
        have[node] = x
    return n


def test_parsimony(patterns):
    rows = parsimony.fitch_fold(patterns, TREE).collect()
    assert all(r.changes == fitch([r[f"c{k}"] for k in range(1, 8)], TREE) for r in rows)
    assert parsimony.scores(patterns, [TREE])[0] == sum(r.w * r.changes for r in rows)
    best, score = parsimony.stepwise_addition(patterns, [str(i) for i in range(1, 8)])
    assert set(best.tip) == set(TREE.tip) and parsimony.scores(parsimony.informative_patterns(patterns), [best])[0] == score


def test_search_improves_and_history(patterns):
    start = tr.random_tree([str(i) for i in range(1, 8)], 3)
    first = lk.loglik_many(patterns, [(start, md.jc69())])[0]
    t, lnl, _ = search.nni_search(patterns, start, md.jc69(), 1)
    assert lnl >= first
    h = search.History()
    h.commit(start)
    h.commit(t)
    assert h.rollback() == start
    best = search.BestTrees(2)
    for x, v in ((start, -3.0), (t, -2.0), (t, -5.0)):
        best.insert(x, v)
    assert best.recall(1)[1] == -2.0


def test_splits_match_the_tree(spark):
    trees = [TREE, tr.random_tree([str(i) for i in range(1, 8)], 9)]
    rows = splits.splits(splits.tree_rows(spark, trees)).collect()
    for i, t in enumerate(trees):
        assert {r.split[0] for r in rows if r.tree_id == i} == set(t.splits())
    rf = splits.robinson_foulds(splits.splits(splits.tree_rows(spark, trees)), 7).first()
    assert rf.rf == trees[0].robinson_foulds(trees[1])


@pytest.mark.parametrize("tips", [64, 65, 80, 500])
def test_splits_of_many_tips(spark, tips):
    names = [str(i) for i in range(1, tips + 1)]
    one = tr.random_tree(names, 3)
    trees = [one, one.swap(one.inner_edges[0], 0), one.swap(one.inner_edges[9], 1).swap(one.inner_edges[30], 0), tr.random_tree(names, 4)]
    found = splits.splits(splits.tree_rows(spark, trees)).cache()
    numbers = {n: i for i, n in enumerate(sorted(names, key=lambda x: (len(x), x)))}
    for i, t in enumerate(trees):
        want = set()
        for e in t.inner_edges:
            side = {t.name[n] for n in t.subtree(*e) if t.is_tip(n)}
            side = side if "1" not in side else set(names) - side
            want.add(sum(1 << numbers[n] for n in side))
        got = {sum((w % (1 << 64)) << 64 * b for b, w in enumerate(r.split)) for r in found.where(f"tree_id = {i}").collect()}
        assert got == want
    rf = {(r.a, r.b): r.rf for r in splits.robinson_foulds(found, tips).collect()}
    assert rf == {(i, j): trees[i].robinson_foulds(trees[j]) for i, j in itertools.combinations(range(4), 2)}
    texts = spark.createDataFrame([(i, t.newick()) for i, t in enumerate(trees)], "tree_id long, newick string")
    assert splits.splits(splits.rows_of_text(texts)).exceptAll(found.select(F.col("tree_id").cast("long").alias("tree_id"), "split")).count() == 0


@pytest.mark.parametrize("taxa", [30, 500])
def test_one_entry_for_trees_of_any_size(spark, taxa):
    rng = random.Random(2)
    t = tr.random_tree([str(i) for i in range(1, taxa + 1)], 7, 0.3)
    rows = spark.createDataFrame([[rng.choice([1, 2, 4, 8, 15]) for _ in range(taxa)] + [rng.randrange(1, 4)] for _ in range(5)], ", ".join(f"c{i} int" for i in range(1, taxa + 1)) + ", w long")
    codes = np.array([[r[f"c{i}"] for i in range(1, taxa + 1)] for r in rows.collect()])
    w = np.array([r.w for r in rows.collect()])
    kernel = lk.Kernel(t, GTR)
    assert math.isclose(lk.tree_loglik(rows, t, GTR).first().lnl, float(w @ kernel.lnl(codes)), rel_tol=1e-9)
    assert lk.corrected_for_invariant(rows, t, GTR).first().lnl_corrected is not None
    node = t.inner_edges[3][0]
    got = lk.ancestral(rows, t, GTR, node).collect()
    for r in got:
        p = [r[f"p{s}"] for s in range(4)]
        assert math.isclose(sum(p), 1, rel_tol=1e-9) and (r.ch == "?" or p["ACGT".index(r.ch)] == max(p))
    if taxa == 30:  # both forms
        df, have = lk.node_columns(rows, t, GTR, ("w",), root=node)
        raw = df.select([sum(F.lit(float(GTR.category_weights[k] * GTR.freqs[s])) * F.col(row[s]) for k, row in enumerate(have[node])).alias(f"r{s}") for s in range(4)]).collect()
        for a, b in zip(raw, got, strict=True):
            assert np.allclose(np.array(a) / sum(a), [b[f"p{s}"] for s in range(4)])


def test_corrected_derivatives(patterns):
    got = lk.corrected_derivatives(patterns, TREE, GTR)
    for e in TREE.edges[:4]:
        h = 1e-4
        x = [lk.corrected_for_invariant(patterns, TREE.with_lengths({e: TREE.length[e] + d}), GTR).first().lnl_corrected for d in (-h, 0, h)]
        assert math.isclose(got[e][0], (x[2] - x[0]) / (2 * h), rel_tol=1e-3, abs_tol=1e-3)
        assert math.isclose(got[e][1], (x[2] - 2 * x[1] + x[0]) / h**2, rel_tol=1e-2, abs_tol=0.5)


def test_rates_by_category_in_one_pass(columns):
    rates = (0.2, 0.9, 2.2)
    rows = al.compress(columns.withColumn("category", (F.col("site") % 3).cast("int")), ["category"])
    got = {r.category: r.lnl for r in lk.loglik_by_category(rows, TREE, md.jc69(), "category", rates).collect()}
    for k, rate in enumerate(rates):
        assert math.isclose(got[k], lk.tree_loglik(rows.where(f"category = {k}"), TREE, md.jc69((rate,))).first().lnl, rel_tol=1e-9)


def test_numbering_in_groups(spark, columns):
    cs = [f"c{k}" for k in range(1, 8)]
    rows = columns.collect()
    order = {x: i + 1 for i, x in enumerate(sorted({tuple(r[c] for c in cs) for r in rows}))}
    assert {r.site: r.pattern_id for r in al.pattern_numbers(columns).collect()} == {r.site: order[tuple(r[c] for c in cs)] for r in rows}


def test_residues_are_numbered_over_runs(spark, monkeypatch):
    from cladespark.operators import msa

    monkeypatch.setattr(msa, "RUN", 3)
    a, b = "AC-GT--ACG-TA", "-CCGTAA-CG--A"
    cells = spark.createDataFrame([(i, t, x) for t, s in ((1, a), (2, b)) for i, x in enumerate(s)], "site long, taxon int, ch string")
    place = [[len(s[:i].replace("-", "")) + 1 for i in range(len(s))] for s in (a, b)]
    want = {(1, 2, place[0][i], place[1][i]) for i in range(len(a)) if a[i] != "-" and b[i] != "-"}
    assert {tuple(r) for r in msa.residue_pairs(cells).select("a", "b", "i", "j").collect()} == want


def test_frequencies_share_ambiguity(spark):
    rows = spark.createDataFrame([(1, 2, 3), (5, 15, 1), (8, 8, 2)], "c1 int, c2 int, w long")
    f = np.full(4, 0.25)
    cells = [(1, 3), (2, 3), (5, 1), (15, 1), (8, 2), (8, 2)]
    for _ in range(8):
        s = np.zeros(4)
        for code, w in cells:
            on = np.array([code >> k & 1 for k in range(4)]) * f
            s += w * on / on.sum()
        f = s / s.sum()
    got = [r.freq for r in al.base_frequencies(rows).orderBy("state").collect()]
    assert np.allclose(got, f)


def test_rate_categories(patterns):
    rated = lk.best_rates(patterns, TREE, md.jc69(), [0.1, 0.5, 1.0, 4.0])
    out = lk.rate_categories(rated, 2).collect()
    assert len(out) <= 2 and math.isclose(sum(r.n * r.rate for r in out) / sum(r.n for r in out), 1, rel_tol=1e-9)


def test_ascertainment_probability(patterns):
    r = lk.corrected_for_invariant(patterns, TREE, GTR).first()
    want = sum(math.exp(brute_lnl([1 << s] * 7, TREE, GTR)) for s in range(4))
    assert math.isclose(r.p_constant, want, rel_tol=1e-9) and r.lnl_corrected > r.lnl


def test_sampler_is_repeatable(patterns):
    got = [mcmc.sample(patterns, TREE, md.jc69().with_alpha(1.0), 2, 20, 10, 3).orderBy("chain", "step").collect() for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == 4


def test_the_sampler_gets_every_pattern(spark, monkeypatch):
    from cladespark import catalogue

    seen = []
    monkeypatch.setattr(mcmc, "sample", lambda patterns, *rest: seen.append(patterns) or spark.createDataFrame([(0, 1, -1.0, 0.5, 1.0, 1.0, "")], "chain int, step int, lnl double, accepted double, alpha double, tree_length double, topology string"))
    catalogue.queries()["sample_trees"](spark, "/root/testdata/sf0.001")
    assert seen[0].count() == catalogue.patterns(spark, "/root/testdata/sf0.001").count() > 400


def emission(a, seqs, at, step, ancestral):
    """Probability of the letters of a column."""
    total = 0.0
    for s, f in enumerate(a.freqs):
        p = f
        for k in range(a.n):
            if step[k]:
                i = a.letters.index(seqs[k][at[k]])
                p *= a.p[k][s, i] if ancestral else float(s == i)
        total += p
    return total


def all_histories(aligner, seqs, silent=12):
    """Probability by enumerating column sequences, with up to `silent` empty columns between emitting ones."""
    table = [aligner.moves(i) for i in range(len(aligner.states))]
    back = math.prod(aligner.fid[k][statalign.B_, statalign.B_] for k in range(aligner.n))

    def go(at, state):
        total = 1.0 if all(a == len(s) for a, s in zip(at, seqs)) else 0.0
        return total + after(at, state)

    def after(at, state):
        total = 0.0
        for to, step, q, anc in table[state]:
            nxt = tuple(a + d for a, d in zip(at, step))
            if all(a <= len(s) for a, s in zip(nxt, seqs)):
                total += q * emission(aligner, seqs, at, step, anc) * full(nxt, to)
        return total

    def full(at, state):
        s = aligner.states[state]
        total, p, here = go(at, state), math.prod(aligner.fid[k][s[k], statalign.B_] for k in range(aligner.n)), None
        for _ in range(silent * 20):
            here = here if here is not None else go(at, aligner.silent)
            total += p * here
            p *= back
        return total

    return full((0,) * aligner.n, 0)


@pytest.mark.parametrize("seqs", [("A", "C"), ("AC", "A"), ("ACG", "AG"), ("", "A")])
def test_lattice_against_enumeration(seqs):
    a = statalign.StarAligner(md.jc69(), 0.3, 2.0, (0.4, 0.6))
    total, lattice = a.forward(seqs)
    assert math.isclose(total, all_histories(a, seqs), rel_tol=1e-6)
    rng = random.Random(1)
    for _ in range(5):
        rows = a.rows(seqs, a.trace(lattice, rng))
        assert [r.replace("-", "") for r in rows] == list(seqs) and len({len(r) for r in rows}) == 1


def test_three_leaves_and_resampling():
    a = statalign.StarAligner(md.jc69(), 0.2, 2.0, (0.2, 0.3, 0.4))
    rows = ["ACGT-A", "AC-TTA", "A-GTTA"]
    out = statalign.resample(a, rows, 3, 4, random.Random(2))
    assert [r.replace("-", "") for r in out] == [r.replace("-", "") for r in rows]


def test_fid_rows_sum_to_one():
    for t in (0.01, 0.5, 3.0):
        assert np.allclose(statalign.fid_matrix(0.8, 6, t).sum(axis=1), 1)


def test_gamma_rates_one():
    assert math.isclose(gamma_rates(1.0)[0], 4 * (1 - 0.75 * (1 - math.log(0.75))), rel_tol=1e-9)


def test_partition_problems(spark):
    sites = spark.range(1, 11).select(F.col("id").alias("site"))
    bad = spark.createDataFrame([(0, 1, 5, 1), (1, 5, 9, 2), (2, 12, 12, 1)], "partition int, lo long, hi long, stride long")
    r = al.partition_problems(sites, bad).first()
    assert (r.n_overlap, r.n_uncovered, r.n_outside) == (1, 3, 1)


def test_compress_cells(spark):
    """The same patterns as by columns, shuffled in a fraction of the width."""
    rng = random.Random(8)
    rows = [(s, t, rng.choice([1, 4, 8, 15])) for s in range(30) for t in range(1, 51) if rng.random() < 0.2 or s % 3 == 0 and t in (16, 17, 49)] + [(99, 50, 2), (98, 7, None)]
    cells = spark.createDataFrame(rows + [(s + 200, t, c) for s, t, c in rows], "site int, taxon int, code int")
    got, want = al.compress_cells(cells, range(1, 50)), al.compress(al.columns_from_cells(cells, range(1, 50)))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    shuffles = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in line]
    assert shuffles and not any("c49" in line for line in shuffles)


def test_partition_of_many_sites(spark):
    """Regions whose sites no row or broadcast could hold."""
    top = 7_000_000_000
    sites = spark.createDataFrame([(-3,), (1,), (2,), (3,), (65_536,), (65_537,), (6_999_999_999,), (top,), (None,)], "site long")
    regions = spark.createDataFrame([(0, 1, top, 3), (1, top, 2, -3), (2, 9, 2, 1), (3, 3, 3, 0), (4, -5, -1, 2), (5, None, 9, 1)], "partition int, lo long, hi long, stride long")
    got = al.bind_partitions(sites, regions)
    assert got.columns == ["site", "partition"]
    want = {(s, p) for s in (-3, 1, 2, 3, 65_536, 65_537, 6_999_999_999, top) for p, x in enumerate([range(1, top + 1, 3), range(top, 1, -3), range(9, 3), range(3, 4), range(-5, 0, 2)]) if s in x}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [r.site for r in al.exclude_sites(sites.where("site > 0"), spark.createDataFrame([(2, top - 1)], "lo long, hi long")).orderBy("site").collect()] == [1, top]


def test_region_blocks(spark):
    regions = spark.createDataFrame([(0, 1, 300_000, 1), (1, 70_000, 5, -7)], "partition int, lo long, hi long, stride long")
    rows = al.region_blocks(regions).collect()
    for p, sites in enumerate([range(1, 300_001), range(70_000, 4, -7)]):
        mine = [range(r.lo, r.hi + 1, r.stride) for r in rows if r.partition == p]
        assert sorted(x for r in mine for x in r) == sorted(sites) and all(r[-1] >> al.BLOCK_BITS == r[0] >> al.BLOCK_BITS for r in mine)


def test_streaming_patterns(spark, columns, tmp_path):
    from cladespark.streaming.patterns import running_patterns

    columns.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_patterns(stream).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("running")
    assert got.exceptAll(al.compress(columns)).count() == 0 and got.agg(F.sum("w")).first()[0] == 60


def every_path(seqs):
    """All sequences of steps that use up the sequences."""
    kinds = [k for k in itertools.product((0, 1), repeat=len(seqs)) if any(k)]

    def go(at):
        if all(a == len(s) for a, s in zip(at, seqs, strict=True)):
            yield []
        for k in kinds:
            after = tuple(a + d for a, d in zip(at, k, strict=True))
            if all(a <= len(s) for a, s in zip(after, seqs, strict=True)):
                for rest in go(after):
                    yield [k, *rest]

    return list(go((0,) * len(seqs)))


def test_lattice_of_given_alignments_and_homologies():
    a = statalign.StarAligner(md.jc69(), 0.3, 2.0, (0.4, 0.6))
    seqs = ("ACG", "AG")
    total, _ = a.forward(seqs)
    each = {}
    for path in every_path(seqs):
        rows = a.rows(seqs, path)
        assert statalign.steps_of(rows) == path
        each[tuple(rows)] = a.forward(seqs, statalign.in_alignment(rows))[0]
    assert len(each) > 20 and math.isclose(sum(each.values()), total, rel_tol=1e-9)
    fixed = sum(p for rows, p in each.items() if (2, 1) in statalign.homologies(rows))
    got, lattice = a.forward(seqs, statalign.with_homologies([(0, 2, 1, 1)]))
    assert math.isclose(got, fixed, rel_tol=1e-9) and 0 < fixed < total
    assert (2, 1) in statalign.homologies(a.rows(seqs, a.trace(lattice, random.Random(4))))


def test_drawn_histories_follow_their_probabilities():
    a = statalign.StarAligner(md.jc69(), 0.3, 2.0, (0.4, 0.6))
    seqs, rng, n = ("AC", "A"), random.Random(8), 4000
    total, lattice = a.forward(seqs)
    seen = {}
    for _ in range(n):
        rows = tuple(a.rows(seqs, a.trace(lattice, rng)))
        seen[rows] = seen.get(rows, 0) + 1
    for rows, k in seen.items():
        p = a.forward(seqs, statalign.in_alignment(rows))[0] / total
        assert abs(k / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_lattice_of_tables():
    a = statalign.StarAligner(md.jc69(), 0.3, 2.0, (0.4, 0.6))
    table = a.table("ACG")
    table[1] = (1, 1, 0, 0)
    assert math.isclose(a.forward((table, "AG"))[0], a.forward(("AAG", "AG"))[0] + a.forward(("ACG", "AG"))[0], rel_tol=1e-9)
    assert math.isclose(a.forward((a.table("ACG"), "AG"))[0], a.forward(("ACG", "AG"))[0], rel_tol=1e-12)


def test_progressive_start(spark):
    quartet = tr.parse("((a:0.05,b:0.05):0.05,(c:0.05,d:0.05):0.05);")
    same = dict.fromkeys("abcd", "ACGTTGCA")
    assert statalign.progressive(md.jc69(), 0.05, 3.0, quartet, same) == same
    seqs = {"a": "ACGTTGCAAC", "b": "ACGTTGCAAC", "c": "ACGTGCAAC", "d": ""}
    rows = statalign.progressive(md.jc69(), 0.1, 2.0, quartet, seqs)
    assert {n: r.replace("-", "") for n, r in rows.items()} == seqs and len({len(r) for r in rows.values()}) == 1
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["ACGTTGCAAC", "ACGTTGCAAC", "ACGTGCAAC"])], "region long, names array<string>, seqs array<string>")
    assert statalign.align_trees(df, md.jc69(), 0.1, 2.0, quartet).first().rows == [rows[n] for n in "abcd"]


def test_line_search_of_rates(patterns):
    grid = [2.0 ** (k / 2) for k in range(-8, 7)]
    coarse = lk.best_rates(patterns, TREE, md.jc69(), grid)
    fine = lk.best_rates(patterns, TREE, md.jc69(), grid, halvings=4)
    a, b = ({tuple(r.states): r for r in d.collect()} for d in (coarse, fine))
    assert a.keys() == b.keys() and all(b[k].lnl >= a[k].lnl for k in a) and any(b[k].lnl > a[k].lnl + 1e-6 for k in a)
    for r in list(b.values())[:10]:
        assert math.isclose(lk.Kernel(TREE, md.jc69((r.rate,))).lnl(np.array([r.states]))[0], r.lnl, abs_tol=1e-6)
    one = lk.loglik_many(patterns, [(TREE, md.jc69())])[0]
    rates, lnl, better = lk.optimise_site_rates(patterns, TREE, md.jc69(), grid, 4, 3, ([1.0], one))
    assert better and lnl > one and 1 <= len(rates) <= 4
    assert lk.optimise_site_rates(patterns, TREE, md.jc69(), grid, 1, 0, ([0.5], lnl + 1)) == ([0.5], lnl + 1, False)


def test_kept_rates_weigh_most(spark):
    rows = [(1, 1.0, -5.0), (100, 2.0, -6.0), (90, 8.0, -7.0)]
    got = lk.rate_categories(spark.createDataFrame(rows, "w long, rate double, lnl double"), 2).collect()
    assert [r.n for r in got] == [101, 90]


def test_rapid_search(patterns):
    start = tr.random_tree([str(i) for i in range(1, 8)], 19)
    fitted, lnl, n = search.rapid_search(patterns, start, md.jc69(), 2, thorough=1)
    first = optimize.newton_lengths(patterns, start, md.jc69(), 0.1)
    assert lnl >= first[1] and (n > 0) == (lnl > first[1])
    moves, starts = search.rapid_sweep(patterns, *first[:1], md.jc69(), first[1], 5, math.inf)
    every = search.scored(patterns, search.spr_moves(first[0], 1, 5), md.jc69())
    if every[0].lnl > first[1]:
        assert math.isclose(moves[0].lnl, every[0].lnl, abs_tol=1e-6)
    assert len(starts) == len(set(starts)) <= 50


def test_models_with_both_frequencies_and_random_orders(patterns):
    both = optimize.both_frequencies({"JC": (md.jc69(), 0)}, (0.1, 0.2, 0.3, 0.4))
    assert list(both) == ["JC", "JC+F"] and both["JC+F"][1] == 3 and both["JC+F"][0].freqs == (0.1, 0.2, 0.3, 0.4)
    names = [str(i) for i in range(1, 8)]
    a, b = (parsimony.stepwise_addition(patterns, names, seed=3) for _ in range(2))
    assert a[0].canonical() == b[0].canonical() and a[1] == b[1] and sorted(a[0].tip) == names
