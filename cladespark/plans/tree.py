"""Immutable unrooted trees: text form, traversals, rearrangements, splits. Every change gives a new tree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

from ..functions.branch import Z_DEFAULT

_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+")
DEFAULT_LENGTH = 0.1


@dataclass(frozen=True)
class Tree:
    """Nodes are numbers; tips have names. edges: (u, v) with u < v -> length."""

    names: tuple[tuple[int, str], ...]
    lengths: tuple[tuple[tuple[int, int], float], ...]

    @classmethod
    def make(cls, names: dict[int, str], lengths: dict[tuple[int, int], float]) -> Tree:
        return cls(tuple(sorted(names.items())), tuple(sorted(((min(e), max(e)), float(t)) for e, t in lengths.items())))

    @cached_property
    def name(self) -> dict[int, str]:
        return dict(self.names)

    @cached_property
    def tip(self) -> dict[str, int]:
        return {n: i for i, n in self.names}

    @cached_property
    def length(self) -> dict[tuple[int, int], float]:
        return dict(self.lengths)

    @cached_property
    def near(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for (u, v), _ in self.lengths:
            out.setdefault(u, []).append(v)
            out.setdefault(v, []).append(u)
        return {k: sorted(v) for k, v in out.items()}

    def t(self, u: int, v: int) -> float:
        return self.length[min(u, v), max(u, v)]

    @property
    def edges(self) -> list[tuple[int, int]]:
        return [e for e, _ in self.lengths]

    @property
    def inner_edges(self) -> list[tuple[int, int]]:
        return [(u, v) for u, v in self.edges if u not in self.name and v not in self.name]

    def is_tip(self, node: int) -> bool:
        return node in self.name

    @cached_property
    def root(self) -> int:
        """An inner node next to the first tip (a tip where there is no inner node)."""
        first = self.names[0][0]
        return self.near[first][0] if len(self.names) > 2 else first

    def postorder(self, root: int | None = None) -> list[tuple[int, int | None]]:
        """(node, parent), children first, without recursion."""
        root = self.root if root is None else root
        stack, out = [(root, None)], []
        while stack:
            node, parent = stack.pop()
            out.append((node, parent))
            stack += [(n, node) for n in reversed(self.near[node]) if n != parent]
        return out[::-1]

    def subtree(self, node: int, parent: int) -> set[int]:
        out, stack = set(), [(node, parent)]
        while stack:
            n, p = stack.pop()
            out.add(n)
            stack += [(m, n) for m in self.near[n] if m != p]
        return out

    def with_lengths(self, new: dict[tuple[int, int], float]) -> Tree:
        return Tree.make(self.name, self.length | {(min(e), max(e)): t for e, t in new.items()})

    # splits ---------------------------------------------------------------------------------------------------

    def splits(self, trivial: bool = False) -> dict[int, tuple[int, int]]:
        """bitmask of the tips (in order of names) on the side without the first tip -> edge."""
        place = {i: k for k, (i, _) in enumerate(sorted(self.names, key=lambda x: x[1]))}
        full, below, out = (1 << len(place)) - 1, {}, {}
        for node, parent in self.postorder():
            below[node] = 1 << place[node] if node in place else 0
            for n in self.near[node]:
                if n != parent:
                    below[node] |= below[n]
            if parent is not None:
                mask = below[node] if not below[node] & 1 else full ^ below[node]
                if trivial or 1 < bin(mask).count("1") < len(place) - 1:
                    out[mask] = (node, parent)
        return out

    def canonical(self) -> tuple[int, ...]:
        return tuple(sorted(self.splits()))

    def robinson_foulds(self, other: Tree, normal: bool = False) -> float:
        d = len(set(self.splits()) ^ set(other.splits()))
        return d / (2 * (len(self.names) - 3)) if normal else d

    # rearrangements -------------------------------------------------------------------------------------------

    def swap(self, edge: tuple[int, int], which: int) -> Tree:
        """Nearest-neighbour interchange over an inner edge (u, v): a neighbour of u changes places with one of v."""
        u, v = edge
        if self.is_tip(u) or self.is_tip(v):
            raise ValueError("an inner edge is expected")
        a = [n for n in self.near[u] if n != v][1]
        b = [n for n in self.near[v] if n != u][which]
        new = dict(self.length)
        ta, tb = new.pop((min(u, a), max(u, a))), new.pop((min(v, b), max(v, b)))
        return Tree.make(self.name, new | {(v, a): ta, (u, b): tb})

    def prune_regraft(self, node: int, at: int, edge: tuple[int, int]) -> Tree:
        """Take the subtree of `node` off its attachment `at` (an inner node) and put it on `edge` of the rest.

        The two edges that meet at `at` are joined, the target is cut in halves."""
        x, y = (n for n in self.near[at] if n != node)
        new = dict(self.length)
        joined = new.pop((min(at, x), max(at, x))) + new.pop((min(at, y), max(at, y)))
        new[min(x, y), max(x, y)] = joined
        p, q = edge
        t = new.pop((min(p, q), max(p, q)))
        return Tree.make(self.name, new | {(at, p): t / 2, (at, q): t / 2})

    def regraft_targets(self, node: int, at: int, low: int, high: int) -> list[tuple[int, int]]:
        """Edges of the rest that are low to high edges away from where the subtree was."""
        x, y = (n for n in self.near[at] if n != node)
        out, seen = [], {at}
        layer, depth = [(x, at), (y, at)], 0
        while layer and depth < high:
            depth, after = depth + 1, []
            for n, p in layer:
                seen.add(n)
                for m in self.near[n]:
                    if m != p and m not in seen:
                        if depth >= low:
                            out.append((n, m))
                        after.append((m, n))
            layer = after
        return out

    def prunable(self) -> list[tuple[int, int]]:
        """(subtree node, attachment) for every way to prune."""
        return [(n, a) for u, v in self.edges for n, a in ((u, v), (v, u)) if not self.is_tip(a)]

    def bisect_reconnect(self, edge: tuple[int, int], left: tuple[int, int], right: tuple[int, int]) -> Tree:
        """Cut an inner edge and join the parts by a new edge between an edge of either part (edges of the joined parts)."""
        u, v = edge
        new = dict(self.length)
        t = new.pop((min(u, v), max(u, v)))
        for node, target in ((u, left), (v, right)):
            x, y = (n for n in self.near[node] if n not in (u, v))
            new[min(x, y), max(x, y)] = new.pop((min(node, x), max(node, x))) + new.pop((min(node, y), max(node, y)))
            p, q = min(target), max(target)
            half = new.pop((p, q)) / 2
            new |= {(min(node, p), max(node, p)): half, (min(node, q), max(node, q)): half}
        return Tree.make(self.name, new | {(u, v): t})

    def reconnect_targets(self, edge: tuple[int, int], radius: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Pairs of edges for bisect_reconnect at most radius edges from the cut in all."""
        sides = []
        for node, other in (edge, edge[::-1]):
            x, y = (n for n in self.near[node] if n != other)
            reach = [((x, y), 0)]
            layer = [(x, node), (y, node)]
            for depth in range(1, radius + 1):
                after = []
                for n, p in layer:
                    for m in self.near[n]:
                        if m != p:
                            reach.append(((n, m), depth))
                            after.append((m, n))
                layer = after
            sides.append(reach)
        return [(a, b) for a, i in sides[0] for b, j in sides[1] if 0 < i + j <= radius]

    # text -----------------------------------------------------------------------------------------------------

    def newick(self, lengths: bool = True, names: bool = True, support: dict[tuple[int, int], float] | None = None, inner: bool = False, digits: int = 6) -> str:
        done: dict[int, str] = {}
        for node, parent in self.postorder():
            kids = [done.pop(n) for n in self.near[node] if n != parent]
            text = f"({','.join(kids)})" if kids else ""
            if node in self.name:
                text += self.name[node] if names else str(node)
            elif parent is not None and support:
                text += f"{support.get((min(node, parent), max(node, parent)), 0):g}"
            elif inner and parent is not None:
                text += str(node)
            if parent is not None and lengths:
                text += f":{self.t(node, parent):.{digits}f}"
            done[node] = text
        return done[self.root] + ";"


def mean_lengths(trees: Sequence[Tree], shares: Sequence[float]) -> Tree:
    """One topology with lengths of its own for each gene: the mean of each length, weighted by the genes' shares."""
    if len(trees) != len(shares) or any(t.edges != trees[0].edges for t in trees):
        raise ValueError("one share for each gene, and the same edges in all, are expected")
    return trees[0].with_lengths({e: sum(t.length[e] * s for t, s in zip(trees, shares, strict=True)) / sum(shares) for e in trees[0].edges})


def newick_per_gene(trees: Sequence[Tree], names: Sequence[str], **switches) -> str:
    """A line `[name] tree` for each gene."""
    return "".join(f"[{n}] {t.newick(**switches)}\n" for n, t in zip(names, trees, strict=True))


def newick_nodes(text: str) -> list[tuple[int, int, int, str, float | None, bool, int]]:
    """(node, parent, depth, label, length, is_leaf, children) in order of opening; the root's parent is -1.

    Raises ValueError for unbalanced or empty text."""
    nodes: list[list] = []
    stack: list[int] = []
    current, after_colon, closed = -1, False, False

    def open_node() -> int:
        parent = stack[-1] if stack else -1
        nodes.append([len(nodes), parent, len(stack), "", None, True, 0])
        if parent >= 0:
            nodes[parent][5] = False
            nodes[parent][6] += 1
        return len(nodes) - 1

    for token in _TOKEN.findall(text):
        if token[0] == "[":
            continue
        if closed:
            raise ValueError("text after the end of the tree")
        if token == "(":
            stack.append(open_node())
            current = -1
        elif token == ",":
            if not stack:
                raise ValueError("a comma outside brackets")
            if current < 0:
                open_node()
            current = -1
        elif token == ")":
            if not stack:
                raise ValueError("a bracket closes that was not opened")
            if current < 0:
                open_node()
            current = stack.pop()
        elif token == ":":
            if current < 0:
                current = open_node()
            after_colon = True
            continue
        elif token == ";":
            closed = True
        elif after_colon:
            nodes[current][4] = float(token)
        else:
            if current < 0:
                current = open_node()
            nodes[current][3] = token.strip("'").replace("''", "'")
        after_colon = False
    if stack or not nodes:
        raise ValueError("brackets don't match" if stack else "no tree")
    return [tuple(x) for x in nodes]


def validate(nodes: Sequence[tuple]) -> str:
    """`unrooted` (root of three, inner nodes of two), `rooted` (root of two) or `bad`."""
    ranks = [n[6] for n in nodes if n[1] >= 0]
    if any(r not in (0, 2) for r in ranks) or len(nodes) < 4:
        return "bad"
    return {3: "unrooted", 2: "rooted"}.get(nodes[0][6], "bad")


def parse(text: str, default: float = DEFAULT_LENGTH) -> Tree:
    """The tree of a Newick text; a root of two is taken out, its edges joined."""
    rows = newick_nodes(text)
    tips = sorted(r[3] for r in rows if r[5])
    if len(set(tips)) != len(tips):
        raise ValueError("names repeat")
    number, name, lengths = {}, {}, {}
    k = len(tips)
    for r in rows:
        if r[5]:
            number[r[0]] = tips.index(r[3]) + 1
            name[number[r[0]]] = r[3]
        else:
            k += 1
            number[r[0]] = k
    for r in rows[1:]:
        lengths[number[r[1]], number[r[0]]] = default if r[4] is None else r[4]
    if rows[0][6] == 2:
        root = number[0]
        (e1, t1), (e2, t2) = [(e, t) for e, t in lengths.items() if root in e]
        del lengths[e1], lengths[e2]
        lengths[next(n for n in e1 if n != root), next(n for n in e2 if n != root)] = t1 + t2
    return Tree.make(name, lengths)


def star(names: Sequence[str], length: float = DEFAULT_LENGTH) -> Tree:
    """The one tree of three tips."""
    return Tree.make({i + 1: n for i, n in enumerate(names)}, {(i + 1, 1 << 20): length for i in range(3)})


def insert_tip(tree: Tree, name: str, edge: tuple[int, int], length: float = DEFAULT_LENGTH) -> Tree:
    tip = max(tree.name) + 1
    inner = max(1 << 20, *(n for e in tree.edges for n in e)) + 1
    new = dict(tree.length)
    t = new.pop((min(edge), max(edge)))
    return Tree.make(tree.name | {tip: name}, new | {(edge[0], inner): t / 2, (edge[1], inner): t / 2, (tip, inner): length})


def random_tree(names: Sequence[str], seed: int = 1, length: float = DEFAULT_LENGTH) -> Tree:
    rng = random.Random(seed)
    order = list(names)
    rng.shuffle(order)
    tree = star(order[:3], length)
    for n in order[3:]:
        tree = insert_tip(tree, n, rng.choice(tree.edges), length)
    return renumber(tree)


def renumber(tree: Tree) -> Tree:
    """Tips numbered by name from 1, inner nodes after them in postorder."""
    new = {tree.tip[n]: i + 1 for i, n in enumerate(sorted(tree.tip))}
    for node, _ in tree.postorder():
        if node not in new:
            new[node] = len(new) + 1
    return Tree.make({new[i]: n for i, n in tree.names}, {(new[u], new[v]): t for (u, v), t in tree.lengths})


def nni_neighbours(tree: Tree) -> Iterator[tuple[tuple[int, int], int, Tree]]:
    for e in tree.inner_edges:
        for k in (0, 1):
            yield e, k, tree.swap(e, k)


def reset_lengths(tree: Tree, mean_rate: float = 1.0) -> Tree:
    import math

    return tree.with_lengths(dict.fromkeys(tree.edges, -math.log(Z_DEFAULT) * mean_rate))
