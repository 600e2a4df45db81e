"""SimHash near-duplicate classes by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits, cut into two segments of 32, differ in at most one bit
in one of the segments. So each distinct fingerprint is indexed under its 64 one-wildcard variants (a segment
with one of its bits blanked), equal variants meet in one hash partition, and candidates are verified by
counting the differing bits.

Copies cost nothing: only distinct fingerprints are indexed. In a group of equal variants no list of all pairs
is made: the links that leave a group are a spanning forest of its verified pairs, which keeps every class
whole. A group with more members than `heavy` is dealt again by one-wildcard variants of its remaining bits;
what is left then differs in at most 18 bits and is compared in blocks of bounded size.

Defined results: an empty table gives no rows; a text of any length is read whole; a null or empty text has fingerprint zero and links like any other; a null id joins classes but
isn't a class's name (a class without any id has a null one); rows that share an id belong to the class of their
own text, and to the least id over it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, texts_of
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
_SHIFTS = np.arange(64, dtype=np.uint64)


def _fingerprint(normal: bytes, shingle: int, digest: Callable) -> int:
    """Of one text whose words are joined by single spaces."""
    if not normal:
        return 0
    cuts = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(normal)]
    if len(starts) <= shingle:
        return digest(normal, SEED)
    ends = ends[shingle - 1 :]
    h = np.array([digest(normal[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):  # a long text is counted in parts
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << _SHIFTS).sum())


def _print_batches(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            raw, at = texts_of(batch.column("text"))
            out = np.array([_fingerprint(b" ".join(raw[at[i] : at[i + 1]].tobytes().lower().split()), shingle, xxh64_intdigest) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit SimHash as a signed long."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_print_batches(shingle), "doc_id long, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its 64 variants: the key holds the segment, the blanked bit and the segment's other bits."""
    bit = np.arange(32, dtype=np.uint64)
    for batch in batches:
        every = np.asarray(batch.column("fp")).view(np.uint64)
        for lo in range(0, len(every), 1 << 12):
            fp = every[lo : lo + (1 << 12)]
            keys = []
            for segment in (0, 1):
                part = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
                tag = (np.uint64(32 * segment) + bit) << np.uint64(32)
                keys.append((part[:, None] & ~(np.uint64(1) << bit)[None, :]) | tag[None, :])
            keys = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], ["key", "fp"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a heavy group under one-wildcard variants of the 33 bits in which they may differ, cut 16 and 17."""
    for batch in batches:
        key, fp = np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("fp")).view(np.uint64)
        tag = key >> np.uint64(32)
        segment = tag >> np.uint64(5)
        other = np.where(segment == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
        blank = (np.where(segment == 0, fp, fp >> np.uint64(32)) >> (tag & np.uint64(31))) & np.uint64(1)
        free = other | (blank << np.uint64(32))
        for j in range(33):
            low, width, at = (np.uint64(0), 0xFFFF, j) if j < 16 else (np.uint64(16), 0x1FFFF, j - 16)
            sub = ((free >> low) & np.uint64(width) & ~(np.uint64(1) << np.uint64(at))) | np.uint64(j << 20)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sub.view(np.int64)), batch.column("fp")], ["key", "sub", "fp"])


def forest(fp: np.ndarray, distance: int = DISTANCE, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs at most `distance` bits apart, comparing block by block; fp: distinct uint64."""
    n = len(fp)
    root = np.arange(n)
    left, right = [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(0, n, block):
        for j in range(i, n, block):
            near = np.bitwise_count(fp[i : i + block, None] ^ fp[None, j : j + block]) <= distance
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            for a, b in zip((x + i).tolist(), (y + j).tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    left.append(a)
                    right.append(b)
    return fp[left], fp[right]


def _links(columns: list[str], distance: int, heavy: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verified links of each run of equal keys in sorted rows. The rows of a run over `heavy` go on with their key."""

    def of(key: list[np.ndarray], fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.ones(len(fp) - 1, bool)
        for k in key:
            same &= k[1:] == k[:-1]
        starts = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[starts, len(fp)])
        a, b, k = [], [], []
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a.append(fp[near])
        b.append(fp[near + 1])
        k.append(np.zeros(len(near), np.int64))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if heavy and n > heavy:
                a.append(fp[s : s + n])
                b.append(fp[s : s + n])
                k.append(key[0][s : s + n])
            else:
                x, y = forest(fp[s : s + n], distance)
                a.append(x)
                b.append(y)
                k.append(np.zeros(len(x), np.int64))
        a, b, k = np.concatenate(a), np.concatenate(b), np.concatenate(k)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(k)], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.array(batch.column(c)) for c in [*columns, "fp"]]
            last = np.ones(len(now[-1]), bool)
            for x in now[:-1]:
                last &= x == x[-1]
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut == 0 and held and all(h[0] == x[0] for h, x in zip(held[-1], now[:-1], strict=False)):
                held.append(now)
                continue
            whole = [np.concatenate(x) for x in zip(*held, [y[:cut] for y in now], strict=True)] if held else [y[:cut] for y in now]
            if len(whole[-1]):
                yield from of(whole[:-1], whole[-1].view(np.uint64))
            held = [[y[cut:] for y in now]]
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield from of(whole[:-1], whole[-1].view(np.uint64))

    return run


def links(prints: DataFrame, distance: int = DISTANCE, heavy: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints `distance` (at most 3) or fewer bits apart, enough to keep every class whole."""
    if distance > 3:
        raise ValueError("two segments with one blanked bit find at most three differing bits")
    rows = prints.mapInArrow(_variants, "key long, fp long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keep(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links(["key"], distance, heavy), "a long, b long, key long").distinct())
    fine = found.where("a = b").select("key", F.col("a").alias("fp")).mapInArrow(_finer, "key long, sub long, fp long")
    fine = fine.repartition(parts, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_links(["key", "sub"], distance, None), "a long, b long, key long")
    return found.where("a <> b").select("a", "b").union(fine.select("a", "b")).distinct()


def near_classes(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, heavy: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach."""
    docs = keep(fingerprints(documents, shingle))
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("lo"))
    classes = components(links(prints.select("fp"), distance, heavy))
    named = prints.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    return docs.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
