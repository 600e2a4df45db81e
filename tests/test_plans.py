import itertools
import math

import numpy as np
import pytest

from cladespark.functions.special import chi2_quantile, gamma_quantile, gamma_rates, incomplete_gamma
from cladespark.plans import model as md
from cladespark.plans import tree as tr

TEXT = "(5:0.1,(4:0.2,(2:0.3,(7:0.15,(3:0.1,6:0.2):0.05):0.1):0.12):0.08,1:0.25);"


def test_newick_round_trip_and_shapes():
    t = tr.parse(TEXT)
    again = tr.parse(t.newick())
    assert again.canonical() == t.canonical() and math.isclose(sum(again.length.values()), sum(t.length.values()), rel_tol=1e-6)
    assert tr.validate(tr.newick_nodes("((1,2),(3,4));")) == "rooted"
    assert tr.validate(tr.newick_nodes("(1,2,(3,4));")) == "unrooted"
    assert tr.validate(tr.newick_nodes("(1,(2,3,5),4);")) == "bad"
    assert tr.parse("((1,2),(3,4));").canonical() == tr.parse("(1,2,(3,4));").canonical()
    assert tr.newick_nodes("('a b':1[note],c,d)x;")[1][3] == "a b"
    for bad in ("", "(1,2", "1,2);", "(1,2);x"):
        with pytest.raises(ValueError):
            tr.newick_nodes(bad)


def test_moves_keep_tips_and_are_undone():
    t = tr.random_tree([str(i) for i in range(9)], 4)
    for e, k, n in tr.nni_neighbours(t):
        assert set(n.tip) == set(t.tip) and len(n.edges) == len(t.edges)
        assert n.robinson_foulds(t) == 2
        assert any(b.canonical() == t.canonical() for _, _, b in tr.nni_neighbours(n))
    for node, at in t.prunable():
        for edge in t.regraft_targets(node, at, 1, 3):
            n = t.prune_regraft(node, at, edge)
            assert len(n.edges) == len(t.edges) and set(n.near[at]) >= {node}
            assert math.isclose(sum(n.length.values()), sum(t.length.values()))
    for e in t.inner_edges:
        for left, right in t.reconnect_targets(e, 2):
            assert len(t.bisect_reconnect(e, left, right).edges) == len(t.edges)
    assert t.robinson_foulds(t) == 0


def test_spr_reaches_all_nni_neighbours():
    t = tr.random_tree(list("abcdefg"), 2)
    spr = {t.prune_regraft(n, a, e).canonical() for n, a in t.prunable() for e in t.regraft_targets(n, a, 1, 1)}
    assert {n.canonical() for _, _, n in tr.nni_neighbours(t)} <= spr


@pytest.mark.parametrize("m", [md.jc69(), md.Model((0.3, 0.2, 0.1, 0.4), (1, 2, 0.5, 0.7, 3, 1.0)), md.ordered(5), md.f84((0.1, 0.2, 0.3, 0.4), 2.0), md.equal(20)])
def test_transition_matrices(m):
    p, q = m.p(0.3), m.p(0.5)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p @ q, m.p(0.8))
    f = np.array(m.freqs)
    assert np.allclose(f[:, None] * p, (f[:, None] * p).T)
    assert math.isclose(-(f * np.diag(m.q())).sum(), 1)
    d = m.p_derivatives(0.4)
    assert np.allclose((m.p(0.4 + 1e-6) - m.p(0.4 - 1e-6)) / 2e-6, d[1], atol=1e-6)


def test_jc_closed_form():
    assert math.isclose(md.jc69().p(0.2)[0, 0], 0.25 + 0.75 * math.exp(-4 / 3 * 0.2))


def test_gamma():
    assert math.isclose(incomplete_gamma(2.0, 1.0), 1 - math.exp(-2))
    assert math.isclose(chi2_quantile(0.95, 2), -2 * math.log(0.05), rel_tol=1e-9)
    assert math.isclose(incomplete_gamma(gamma_quantile(0.3, 0.4), 0.4), 0.3, rel_tol=1e-9)
    for alpha, median in itertools.product((0.05, 0.5, 1, 10, 500), (False, True)):
        assert math.isclose(gamma_rates(alpha, 4, median).mean(), 1, rel_tol=1e-6)


def test_linkage_symmetry_and_floor():
    assert md.expand_symmetry("0,1,0,0,1,0", (1, 4)) == (1, 4, 1, 1, 4, 1)
    with pytest.raises(ValueError):
        md.expand_symmetry("0,2", (1, 1))
    assert md.link("0,1,0", 3) == [[0, 2], [1]]
    assert md.check_linkage([[0, 1]], ["DNA", "AA"], [4, 20], [False, False]) == ["group 0: data type differs", "group 0: number of states differs"]
    f = md.smooth_frequencies((0, 0.0004, 0.3, 0.6996))
    assert np.allclose(f, [0.001, 0.001, 0.3 * 0.998 / 0.9996, 0.6996 * 0.998 / 0.9996])
    f = md.smooth_frequencies((0, 0, 0, 0.00101, 0.99899), 0.001)  # scaling pushes one more below
    assert (f >= 0.001).all() and abs(f.sum() - 1) < 1e-12
    with pytest.raises(ValueError):
        md.smooth_frequencies((0.5, 0.5), 0.6)


def test_read_matrix_and_criteria():
    text = " ".join(["1"] * 190 + ["0.05"] * 20)
    m = md.read_matrix(text)
    assert np.allclose(m.p(0.7), md.equal(20).p(0.7))
    assert md.read_matrix(" ".join(["1e+05"] * 190 + ["5E-2"] * 20) + " made by hand").rates[0] == 10
    with pytest.raises(ValueError):
        md.read_matrix(text.replace("1 1", "1 x", 1))
    c = md.criteria(-100.0, 3, 50)
    assert c["aic"] == 206 and math.isclose(c["bic"], 3 * math.log(50) + 200)


def test_paired_site_models():
    from cladespark.plans import secondary as sec

    assert sec.change("AU", "GC") == 0 and sec.change("AU", "GU") == 1 and sec.change("AU", "CG") == 2 and sec.change("AA", "AU") == 3 and sec.change("AA", "AC") == 4 and sec.change("AA", "CC") == -1
    sizes = {"S6A": 15, "S6B": 3, "S6C": 3, "S6D": 2, "S6E": 2, "S7A": 21, "S7B": 21, "S7C": 10, "S7D": 4, "S7E": 2, "S7F": 4, "S16": 120, "S16A": 5, "S16B": 1}
    for name, n in sizes.items():
        groups, freqs = sec.symmetry(name)
        assert max(groups) + 1 == n, name
        k = len(freqs)
        m = sec.paired_model(name, [1.0 + i for i in range(n)], [1 / k] * k)
        assert np.allclose(m.p(0.3).sum(axis=1), 1)
    assert sec.symmetry("S6C")[1] == [0, 1, 1, 2, 0, 2] and sec.symmetry("S7E")[0].count(0) == 4
    with pytest.raises(ValueError):
        sec.symmetry("S16C")


def test_mixture_search_keeps_the_mean(monkeypatch):
    from cladespark.operators import optimize

    m = md.mixture([md.jc69()] * 4, (0.2, 0.6, 1.1, 2.1))
    seen = []
    monkeypatch.setattr(optimize, "loglik_many", lambda patterns, pairs: [seen.append(x) or -abs(x.weights[0] - 0.4) for _, x in pairs])
    best, lnl = optimize.optimise_mixture(None, None, m)
    assert lnl >= -0.15 and all(math.isclose(sum(x.weights), 1) and math.isclose(sum(w * r for w, r in zip(x.weights, x.site_rates)), 1) for x in seen[1:])


def test_lengths_of_genes_and_named_models():
    a = tr.random_tree([str(i) for i in range(6)], 1)
    b = a.with_lengths({e: 3 * a.length[e] for e in a.edges})
    mean = tr.mean_lengths([a, b], [0.75, 0.25])
    assert all(abs(mean.length[e] - 1.5 * a.length[e]) < 1e-12 for e in a.edges)
    lines = tr.newick_per_gene([a, b], ["x", "y"]).splitlines()
    assert [x[:4] for x in lines] == ["[x] ", "[y] "] and tr.parse(lines[1]).robinson_foulds(tr.renumber(a)) == 0
    with pytest.raises(ValueError):
        tr.mean_lengths([a, tr.random_tree([str(i) for i in range(6)], 9)], [0.5, 0.5])
    f = (0.1, 0.2, 0.3, 0.4)
    assert md.named("F84", f, [2.0]) == md.f84(f, 2.0) and md.named("TN93", f, [2.0, 3.0]) == md.tn93(f, 2.0, 3.0) and md.named("GTR", f, range(1, 7)).rates == (1, 2, 3, 4, 5, 6)
