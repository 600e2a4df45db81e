"""Plain SQL for the queries over the canonical alignment; an independent second form of the operators, for checking."""

from __future__ import annotations

from collections.abc import Sequence

from .model import Model
from .tree import Tree

BASE = """
cell as (select l_orderkey as site, l_linenumber as taxon, min(l_partkey) % 4 as k from lineitem group by 1, 2),
piv as (select site, {cs} from cell group by site),
pat as (select {names}, count(*) as w from piv group by {names})
"""


def base(taxa: int = 7) -> str:
    cs = ", ".join(f"coalesce(max(case when taxon = {i} then 1 << cast(k as int) end), 15) as c{i}" for i in range(1, taxa + 1))
    return BASE.format(cs=cs, names=", ".join(f"c{i}" for i in range(1, taxa + 1))).strip()


def number(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def _tip(code: str, row: Sequence[float]) -> str:
    """Sum of a row of probabilities over the states of a code."""
    return "(" + " + ".join(f"({code} >> {j} & 1) * {number(p)}" for j, p in enumerate(row)) + ")"


def node_steps(tree: Tree, model: Model, source: str, keep: Sequence[str], root: int | None = None, tag: str = "t", slope: tuple[tuple[int, int], int] | None = None) -> tuple[list[str], str, list[list[str]]]:
    """Common table expressions, one per inner node; the last one's name, and the root's columns [category][state].

    slope: an edge and an order of derivative; its matrix is then that derivative of the transition matrix by the edge's length, and
    so is the likelihood, which is linear in it."""
    tips = {n: f"c{n}" for n in range(1, len(tree.names) + 1)}
    steps, have, last = [], {}, source
    for node, parent in tree.postorder(root):
        if tree.is_tip(node):
            continue
        kids = [n for n in tree.near[node] if n != parent]
        names, made = [], []
        for r, rate in enumerate(model.site_rates):
            row = []
            for s in range(model.states):
                parts = []
                for k in kids:
                    whole = model.component(r)
                    p = (whole.p_derivatives(tree.t(node, k), rate)[slope[1]] if slope and {node, k} == set(slope[0]) else whole.p(tree.t(node, k), rate))[s]
                    parts.append(_tip(tips[int(tree.name[k])], p) if tree.is_tip(k) else "(" + " + ".join(f"{c} * {number(p[j])}" for j, c in enumerate(have[k][r])) + ")")
                row.append(f"n{node}_{r}_{s}")
                made.append(f"{' * '.join(parts)} as n{node}_{r}_{s}")
            names.append(row)
        for k in kids:
            have.pop(k, None)
        alive = [c for h in have.values() for x in h for c in x]
        name = f"{tag}{node}"
        steps.append(f"{name} as (select {', '.join([*tips.values(), *keep, *alive, *made])} from {last})")
        have[node], last = names, name
    return steps, last, have[tree.root if root is None else root]


def likelihood(model: Model, columns: list[list[str]]) -> str:
    w = model.category_weights
    return " + ".join(f"{number(w[r] * model.component(r).freqs[s])} * {c}" for r, row in enumerate(columns) for s, c in enumerate(row))


def site_lnl(tree: Tree, model: Model, source: str = "pat", keep: Sequence[str] = ("w",), tag: str = "t") -> tuple[list[str], str]:
    """Steps whose last, `<tag>_l`, has the state columns, keep and lnl."""
    steps, last, cols = node_steps(tree, model, source, keep, tag=tag)
    tips = ", ".join(f"c{n}" for n in range(1, len(tree.names) + 1))
    steps.append(f"{tag}_l as (select {tips}, {', '.join(keep)}, ln({likelihood(model, cols)}) as lnl from {last})")
    return steps, f"{tag}_l"


def site_slopes(tree: Tree, model: Model, edge: tuple[int, int], source: str = "pat", keep: Sequence[str] = ("w",), tag: str = "s") -> tuple[list[str], str]:
    """Steps whose last, `<tag>_s`, has keep, the likelihood x0 of each row and its derivatives x1 and x2 by the length of an edge."""
    steps, tips = [], ", ".join(f"c{n}" for n in range(1, len(tree.names) + 1))
    for order in range(3):
        made, last, cols = node_steps(tree, model, source, keep, tag=f"{tag}{order}x", slope=(edge, order))
        steps += [*made, f"{tag}{order} as (select {tips}, {', '.join(keep)}, {likelihood(model, cols)} as x{order} from {last})"]
    on = ", ".join([tips, *keep])
    steps.append(f"{tag}_s as (select * from {tag}0 join {tag}1 using ({on}) join {tag}2 using ({on}))")
    return steps, f"{tag}_s"


def fitch(tree: Tree, source: str = "pat", keep: Sequence[str] = ("w",), tag: str = "t") -> tuple[list[str], str]:
    """Steps whose last has `changes`."""
    tips = [f"c{n}" for n in range(1, len(tree.names) + 1)]
    steps, have, last = [f"{tag}_0 as (select *, 0 as changes from {source})"], {}, f"{tag}_0"
    for node, parent in tree.postorder():
        if tree.is_tip(node):
            have[node] = f"c{tree.name[node]}"
            continue
        kids = [n for n in tree.near[node] if n != parent]
        at = have.pop(kids[0])
        for i, k in enumerate(kids[1:]):
            other = have.pop(k)
            alive = [x for x in have.values() if x not in tips]
            name = f"{tag}{node}_{i}"
            steps.append(f"{name} as (select {', '.join([*tips, *keep, *alive])}, changes + case when {at} & {other} = 0 then 1 else 0 end as changes, case when {at} & {other} = 0 then {at} | {other} else {at} & {other} end as f{node}_{i} from {last})")
            at, last = f"f{node}_{i}", name
        have[node] = at
    return steps, last
