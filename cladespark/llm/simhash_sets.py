"""SimHash classes of shingle sets, wide enough for a similarity of 0.8, by deletion-variant signatures.

A set's fingerprint has BITS bits: the signs of random projections (normal numbers) of the sum of its shingles, each of which
is +1 or -1 in one of SKETCH places. Two sets whose Jaccard similarity is 0.8 have a cosine of 8/9 or more, so a bit differs with
a chance of 0.1515 at most. The first CHECK bits verify; the rest are SEGMENTS segments of 2 * HALF bits. Two sets are
candidates if a segment differs in one bit at most (chance 0.219 for one segment, so at 0.8 all miss for 1 pair in 90,000), and
linked if at most LIMIT of the CHECK bits differ (at 0.8 more do for about 1 pair in 10^6; of unrelated pairs about 1 in 10^9 pass).

Of the two halves of such a segment one is equal. So a row goes to the task of each half's value, 2 * SEGMENTS in all, and the
variants (the other half with one bit blanked) are made there. Runs of equal variants are compared pair by pair; a run over
RUN is searched breadth first, where a row that was reached is compared no more, so a large group of like sets takes a
few passes. A task emits a spanning forest of what it found, never all pairs.

Defined results: empty sets have a fingerprint of zeros; sets with one fingerprint are linked; a table without pairs gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh

BITS, CHECK, LIMIT = 1024, 192, 53
SEGMENTS, HALF = 46, 9
SKETCH, RUN = 2048, 256


@cache
def _planes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(9)).standard_normal((SKETCH, BITS), dtype=np.float32)


def fingerprints(sets: list[np.ndarray], block: int = 256) -> np.ndarray:
    """BITS / 8 bytes of each set of shingle hashes."""
    out = [np.zeros((0, BITS // 8), np.uint8)]
    for lo in range(0, len(sets), block):
        some = sets[lo : lo + block]
        h = wh.mix(np.concatenate(some).astype(np.uint64))
        at = np.repeat(np.arange(len(some)), [len(s) for s in some]) * SKETCH + (h >> np.uint64(32)).astype(np.int64) % SKETCH
        sums = np.bincount(at, 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64), len(some) * SKETCH).reshape(len(some), SKETCH)
        out.append(np.packbits(sums.astype(np.float32) @ _planes() > 0, axis=1))
    return np.concatenate(out)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (node, bits) under its segments' halves: slot holds the segment, which half, its value and the other's."""
    weight = 1 << np.arange(HALF)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 9):
            rows = batch.slice(lo, 1 << 9)
            raw = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            halves = np.unpackbits(raw, axis=1)[:, CHECK : CHECK + 2 * HALF * SEGMENTS].reshape(-1, SEGMENTS, 2, HALF) @ weight
            slot = (np.arange(2 * SEGMENTS).reshape(SEGMENTS, 2) << 2 * HALF) | halves << HALF | halves[:, :, ::-1]
            check = np.ascontiguousarray(raw[:, : CHECK // 8]).view(np.int64)
            each = 2 * SEGMENTS
            columns = [pa.array(slot.astype(np.int32).ravel()), pa.array(np.repeat(np.asarray(rows.column("node")), each)), *(pa.array(np.repeat(c, each)) for c in check.T)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "node", "p0", "p1", "p2"])


def _far(p: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(p[a] ^ p[b]).sum(axis=-1, dtype=np.int64)


def _search(p: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the members' links, breadth first."""
    while len(members):
        reached, members = [int(members[0])], members[1:]
        while reached and len(members):
            x = reached.pop()
            near = _far(p, x, members) <= LIMIT
            new = members[near].tolist()
            yield from ((x, y) for y in new)
            reached += new
            members = members[~near]


def forest(slot: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as row numbers, of the links between rows under equal variants; p: the CHECK bits of each row."""
    codes, found = [], []
    for j in range(HALF):
        variant = slot & ~(1 << j)
        order = np.argsort(variant, kind="stable")
        run = variant[order]
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[starts[1:], len(run)]
        size = np.repeat(ends - starts, ends - starts)
        for s, e in zip(starts[ends - starts > RUN].tolist(), ends[ends - starts > RUN].tolist(), strict=True):
            found += _search(p, order[s:e])
        at, step = np.flatnonzero(size <= RUN), 1
        while len(at):
            at = at[at + step < len(run)]
            at = at[run[at + step] == run[at]]
            a, b = order[at], order[at + step]
            near = _far(p, a, b) <= LIMIT
            codes.append(np.minimum(a, b)[near] * len(slot) + np.maximum(a, b)[near])
            step += 1
    pairs = np.unique(np.concatenate(codes))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in [*found, *zip((pairs // len(slot)).tolist(), (pairs % len(slot)).tolist(), strict=True)]:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in rows sorted by slot; rows with the same half of a segment are held together."""
    names = ["slot", "node", "p0", "p1", "p2"]

    def of(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        slot, node, *p = (np.concatenate(x) for x in zip(*held, strict=True))
        found = np.array(forest(slot, np.stack(p, axis=1).view(np.uint64)), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(batch.column(c)) for c in names]
        half = now[0] >> HALF
        cut = int(np.searchsorted(half, half[-1]))
        if held and (cut or held[-1][0][-1] >> HALF != half[0]):
            yield from of([*held, [x[:cut] for x in now]])
            held = []
        elif cut:
            yield from of([[x[:cut] for x in now]])
        held.append([x[cut:] for x in now])
    if held:
        yield from of(held)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of prints (node, bits; one row a node), enough to keep every SimHash class whole."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.mapInArrow(_slots, "slot int, node long, p0 long, p1 long, p2 long")
    return rows.repartition(parts, F.shiftright("slot", HALF)).sortWithinPartitions("slot").mapInArrow(_linked, "a long, b long").distinct()
