"""The pipeline's stages against brute force, on rows that the unique ids of the tables don't have."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], DOCS)


def prose(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) + "x" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_classes(texts):
    """The class number of each text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if similar(a, sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def near_copies(rng, n=40):
    """Texts with copies at changed words, on both sides of similarity 0.8."""
    out = []
    for _ in range(n):
        base = prose(rng, rng.randrange(20, 300))
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(1, 2 + len(w) // 50)):
                w[rng.randrange(len(w))] = "CHANGED"
            out.append(" ".join(w))
    return out


def test_near_copies_leave_one_row_a_class(spark):
    import corpus_pipeline as cp

    texts = near_copies(random.Random(3))
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    classes = brute_classes(texts)
    assert len(set(classes)) < len({shingles(t) for t in texts})
    want = {min(i for i, c in enumerate(classes) if c == k) for k in set(classes)}
    assert {r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()} == want
    assert cp.near_dedup(spark, frame(spark, rows).where("false"), "").count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_links_do_not_depend_on_blocks(spark, block):
    """Texts that share bands with others and aren't near the least one, in one block and in pairs of blocks."""
    from cladespark.llm import jaccard
    from cladespark.llm.common import keep
    from cladespark.llm.components import components

    rng = random.Random(21)
    texts = []
    for _ in range(4):
        base = prose(rng, 120)
        for _ in range(14):  # a chain: each text is near the one before and ever farther from the first
            at = rng.randrange(len(base))
            base = [*base[:at], "new" + str(rng.randrange(10**6)), *base[at + 1 :]]
            texts.append(" ".join(base))
    df = frame(spark, list(enumerate(texts)))
    docs = df.select(jaccard.row_key(df).alias("k"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = keep(docs.mapInArrow(jaccard._index, "k long, doc_id long, text_key long, node long"))
    met = keep(docs.select("text").mapInArrow(jaccard._bands, "node long, band long").distinct())
    root = {r.node: r.root for r in components(jaccard.links(met, docs, rows, block)).collect()}
    ours = {r.doc_id: root.get(r.node, r.node) for r in rows.collect()}
    want = brute_classes(texts)
    assert len(set(want)) < len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (ours[i] == ours[j]) == (want[i] == want[j])


def test_near_dedup_goes_by_simhash(spark, monkeypatch):
    """Every class of several texts comes through SimHash links: without them each distinct set stays."""
    import corpus_pipeline as cp

    from cladespark.llm import simhash_sets

    texts = near_copies(random.Random(5), 12)
    links = simhash_sets.links
    monkeypatch.setattr(simhash_sets, "links", lambda prints: links(prints).where("false"))
    assert cp.near_dedup(spark, frame(spark, list(enumerate(texts))), "").count() == len({shingles(t) for t in texts}) > len(set(brute_classes(texts)))


@pytest.mark.parametrize("size", [9, 45, 900])
def test_simhash_finds_pairs_at_the_limit(spark, size):
    """300 pairs of sets as little above similarity 0.8 as can be: each pair is linked, and no sets of different pairs."""
    from cladespark.llm import simhash_sets
    from cladespark.llm.components import components

    rng = np.random.default_rng(size)
    both = -(-8 * size // 9)
    unions = [rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) for _ in range(300)]
    prints = simhash_sets.fingerprints([x for u in unions for x in (u[:size], u[size - both :])])
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(prints)], "node long, bits binary")
    assert {r.node: r.root for r in components(simhash_sets.links(df)).collect()} == {i: i - i % 2 for i in range(600)}


def test_simhash_forest_equals_all_pairs():
    """Runs of a few rows and one of over RUN rows, in which links go by chains."""
    from cladespark.llm import simhash_sets as sh

    rng = np.random.default_rng(2)
    p, slot = [], []
    for half, n in ((0, 700), (1, 5), (2, 40)):
        for _ in range(n):
            new = not p or rng.random() < 0.3
            bits = rng.integers(0, 2, sh.CHECK, dtype=np.uint8) if new else p[rng.integers(len(p))] ^ (rng.random(sh.CHECK) < 0.22).astype(np.uint8)
            p.append(bits)
            slot.append(half << sh.HALF | (0 if half == 0 else int(rng.integers(8))))
    p, slot = np.stack(p), np.array(slot, np.int32)
    order = np.argsort(slot, kind="stable")
    p, slot = p[order], slot[order]
    near = ((p[:, None] ^ p[None]).sum(axis=2) <= sh.LIMIT) & (np.bitwise_count(slot[:, None] ^ slot[None]) <= 1) & (slot[:, None] >> sh.HALF == slot[None] >> sh.HALF)

    def classes(pairs):
        root = list(range(len(p)))
        for a, b in pairs:
            if root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    found = sh.forest(slot, np.packbits(p, axis=1).view(np.uint64))
    assert classes(found) == classes(np.argwhere(near).tolist()) and len(found) < len(p) and all(near[a, b] for a, b in found)


def bench_dir(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_leaks_at_every_place_and_length(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    fill = lambda n: " ".join("f" + w for w in prose(rng, n))
    items = [(n, " ".join(prose(rng, n))) for n in (4, 7, 8, 9, 10)]
    rows = [(10 * n + at, f"{fill(20 + at)} {text} {fill(30)}") for n, text in items for at in range(4)]
    clean = [(1000 + i, fill(60)) for i in range(5)]
    sf = bench_dir(spark, tmp_path, [*items, (50, "Zoe 12"), (51, None)])
    assert {r.doc_id for r in cp.decontaminate(spark, frame(spark, rows + clean), sf).collect()} == {i for i, _ in clean}


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_without_or_with_shared_ids_stand_alone(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(6)
    good = [" ".join(prose(rng, 40)) for _ in range(6)]
    bad = "one two three four five six seven eight " * 20
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = bench_dir(spark, tmp_path, [(1, " ".join(prose(rng, 20)))])
    leak = f"{good[5]} {spark.read.parquet(f'{tmp_path}/benchmark.parquet').first().text} {good[4]}"
    rows = [(None, good[0]), (None, bad), (7, good[1]), (7, bad), (None, None), (8, good[2])]
    assert left(cp.quality_rules(spark, frame(spark, rows), sf)) == sorted([rows[0], rows[2], rows[5]], key=repr)
    rows = [(None, good[0]), (None, leak), (7, good[1]), (7, leak), (None, None)]
    assert left(cp.decontaminate(spark, frame(spark, rows), sf)) == sorted([rows[0], rows[2], rows[4]], key=repr)
    near = good[3] + " more"
    rows = [(5, good[0]), (5, good[0]), (None, good[0]), (None, good[1]), (None, good[1]), (9, good[2]), (9, near), (None, good[3]), (4, good[4]), (3, good[4]), (3, good[5])]
    want = [(5, good[0]), (None, good[1]), (9, good[2]), (9, near), (3, good[4]), (3, good[5])]
    assert left(cp.near_dedup(spark, frame(spark, rows), sf)) == sorted(want, key=repr)
