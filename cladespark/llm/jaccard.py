"""Near-duplicate classes by the similarity of shingle sets.

A text is the set of its runs of SHINGLE words (lower-cased; a shorter text is one run). Two texts are near duplicates if
the Jaccard similarity of their sets is at least SIMILAR, and a class is what such pairs reach. The method is SimHash by deletion
variants (simhash_sets): only sets of one SimHash class are compared, and a pair at similarity 0.8 is in one class but for a chance
below 2 in 100,000. An exact check follows, on the sets themselves: all pairs of a SimHash class that could join two classes.

Copies cost nothing: only distinct sets are indexed. Below, a SimHash class is called a band. First every member of a band is compared with the band's least one, a join
whose rows are dealt by pairs, so a group of like texts of any size takes one comparison or a few for each member. What that
joins is one class already; only bands whose members are in several classes then need their members compared with each
other. Such a band goes to a task with its sets, and one of over BLOCK members goes in pairs of blocks, so a task
holds two blocks at most. (Their number grows with the square of a band's members only where so many texts share a band and
most of them aren't near the least one.)

Defined results: an empty table gives no rows; a text of any length is read whole; null and empty texts have the same empty set; repeated rows and rows that share an id belong to the class
of their own text; of a class the row with the least id stays (a null id counts as the greatest), then the least text
hash; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_sets
from . import wordhash as wh
from .common import keep, text_slices
from .components import components

SHINGLE, SIMILAR, ROWS, BANDS = 5, 0.8, 6, 36
#: Members of a band that a task compares with each other, or with as many others.
BLOCK = 2048
#: Odd factors of the least hashes.
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def row_key(docs: DataFrame) -> Column:
    """One number for the id and the text of a row, nulls included."""
    text = docs["text"].cast("string")
    return F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"].cast("long"), text.isNull(), text)


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, raw, at in text_slices(batch):
        raw = np.frombuffer(raw.tobytes().lower(), np.uint8)
        starts, ends, first = wh.spans(raw, at)
        words = wh.word_hashes(raw, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            w = words[a:b]
            yield np.unique(wh.window_hashes(w, min(SHINGLE, len(w)))) if len(w) else np.zeros(0, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set by its least hashes: another way to deal sets, which no query uses; tests hold links() to it."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1 << 10):
        least = np.minimum(least, ((shingles[lo : lo + (1 << 10), None] ^ _SEEDS) * _FACTORS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        out = wh.mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def _name(shingles: np.ndarray) -> int:
    mixed = wh.mix(shingles.copy())
    return int(np.bitwise_xor.reduce(mixed) ^ np.add.reduce(wh.mix(mixed ^ np.uint64(len(shingles))))) if len(shingles) else 0


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.array([_name(s) for s in shingle_sets(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), batch.column("text_key"), pa.array(names.view(np.int64))], ["k", "doc_id", "text_key", "node"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, keys = [], []
        for s in shingle_sets(batch):
            node.append(_name(s))
            keys.append(bands(s))
        if node:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(node, np.uint64), BANDS).view(np.int64)), pa.array(np.concatenate(keys).view(np.int64))], ["node", "band"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bits) of each row."""

    def of(sets: list[np.ndarray]) -> pa.RecordBatch:
        names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in simhash_sets.fingerprints(sets)], pa.binary())], ["node", "bits"])

    for batch in batches:
        sets, size = [], 0
        for s in shingle_sets(batch):
            sets.append(s)
            size += len(s)
            if size > 1 << 18 or len(sets) == 1 << 12:
                yield of(sets)
                sets, size = [], 0
        if sets:
            yield of(sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) whose sets are similar."""
    for batch in batches:
        fine = [similar(_set(x), _set(y)) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))


def forest(nodes: list[int], classes: list[int], sets: list[np.ndarray], block: list[int]) -> Iterator[tuple[int, int]]:
    """Links between similar members of different classes, enough to join all classes that any such pair joins; where there are two
    blocks, only pairs across them (each block is compared within itself elsewhere)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    across = len(set(block)) > 1
    groups: dict[int, list[int]] = {}  # members so far by their class
    for i in range(len(nodes)):
        for c in list(groups):
            if find(c) == find(classes[i]):
                continue
            for j in groups[c]:
                if not (across and block[i] == block[j]) and similar(sets[i], sets[j]):
                    root[find(c)] = find(classes[i])
                    yield nodes[j], nodes[i]
                    break
        merged: dict[int, list[int]] = {}
        for c, members in groups.items():
            merged.setdefault(find(c), []).extend(members)
        groups = merged
        groups.setdefault(find(classes[i]), []).append(i)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (band, x, y) in sorted rows."""

    def of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(forest(*(list(c) for c in zip(*rows, strict=True)))) if rows else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("band", "x", "y", "node", "class", "part")]
        for band, x, y, node, group, part, s in zip(*columns, batch.column("shingles"), strict=True):
            if (band, x, y) != held:
                yield from of(rows)
                held, rows = (band, x, y), []
            rows.append((node, group, np.frombuffer(s.as_py(), np.uint64), part))
    yield from of(rows)


def links(met: DataFrame, docs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between similar sets, enough to keep every class whole. met: (node, band); docs and rows: see near_classes."""
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = met.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").drop("most")
    pairs = keep(met.join(shared, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    # the text of one row for each set that has a candidate
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = rows.join(wanted, "node").groupBy("node").agg(F.min("k").alias("k"))
    sets = keep(docs.select("k", "text").join(one, "k").dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets, "node long, shingles binary"))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    first = keep(both.select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long"))
    classes = keep(components(first))
    named = met.join(shared.select("band"), "band").join(classes, "node", "left").select("band", "node", F.coalesce("root", "node").alias("class"))
    named = keep(named)
    mixed = named.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    mixed = mixed.select("band", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    dealt = named.join(mixed, "band").withColumn("part", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.select("band", "node", "class", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("band", "node", "class", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    ready = dealt.join(sets, "node").repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "node")
    return first.union(ready.mapInArrow(_across, "a long, b long"))


def near_classes(documents: DataFrame) -> DataFrame:
    """(k, doc_id, text_key, class_id) of every row; k is its row_key, class_id is shared by what similar pairs reach."""
    text = documents["text"].cast("string")
    docs = documents.select(row_key(documents).alias("k"), documents["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = keep(docs.mapInArrow(_index, "k long, doc_id long, text_key long, node long"))
    prints = keep(docs.select("text").mapInArrow(_prints, "node long, bits binary").groupBy("node").agg(F.min("bits").alias("bits")))
    met = keep(components(simhash_sets.links(prints)).select("node", F.col("root").alias("band")))
    classes = components(links(met, docs, rows))
    return rows.join(classes, "node", "left").select("k", "doc_id", "text_key", F.coalesce("root", "node").alias("class_id"))


def first_rows(documents: DataFrame) -> DataFrame:
    """(k, n) of the row that stays of each class; n rows have that id and text."""
    every = near_classes(documents).groupBy("class_id", "k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("o"), F.count("*").alias("n"))
    return every.groupBy("class_id").agg(F.min(F.struct("o", "k", "n")).alias("x")).select("x.k", "x.n")
