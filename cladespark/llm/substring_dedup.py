"""Removal of word windows that an earlier document has (substring dedup with difference-cover anchors).

A set D is a difference cover modulo v if any two positions i, j have an offset k < v with both i + k and
j + k in D modulo v. So two equal windows of W words, wherever they start, share an aligned anchor: a window of
W - v + 1 words that starts at a cover position of both texts. Only the anchors (|D| / v of all positions) are
hashed and shuffled; then the matches are extended: round each anchor that several documents have, the full
windows are hashed (two 64-bit hashes that share nothing) and the smallest document of each is found.

Texts without a match cost one anchor row per v / |D| words and nothing else. Hot anchors are handled by partial
aggregation (min and max of the id per hash) and, for the anchors, by a join whose many-row side Spark may split. The join of the
full windows isn't split: an exchange of its own for its small side costs more disk than there is (see the README).

Defined results: a null or empty text has no words; an empty table gives no rows; a text of any length is read whole, in slices; a
document with a null id is returned whole and neither gives nor
loses words; rows that share an id don't count as earlier than each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import keep, text_slices, texts_of

#: Perfect difference sets, by period.
PERFECT_COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}


#: Stands for a null id where texts are dealt out.
NO_ID = -(1 << 63)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and cover for windows of so many words: the longest period that leaves 60 % of it, or 19 words, to the anchor."""
    period = max(v for v in PERFECT_COVERS if window - v + 1 >= min(19, max(1, 0.6 * window)))
    return period, PERFECT_COVERS[period]


def _anchors(window: int, per_doc: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, cover = cover_for(window)
    size = window - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for lo, hi, raw, at in text_slices(batch):
                starts, ends, first = wh.spans(raw, at)
                n = np.diff(first)
                if not (n >= window).any():
                    continue
                words = wh.word_hashes(raw, starts, ends)
                doc = np.repeat(np.arange(hi - lo), n)
                pos = np.arange(len(words)) - first[:-1][doc]
                at_cover = np.flatnonzero(chosen[pos % period] & (pos + size <= n[doc]) & (n[doc] >= window))
                if not len(at_cover):
                    continue
                h = wh.window_hashes(words, size)[at_cover].view(np.int64)
                d, p = ids[lo:hi][doc[at_cover]], pos[at_cover].astype(np.int32)
                if per_doc:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d)], ["h", "doc_id"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(p)], ["h", "doc_id", "pos"])

    return run


def _windows(window: int, wanted: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full windows that hold an anchor whose flag has the bit `wanted` (1: may be the earlier one, 2: may be the later one)."""
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flags = np.asarray(batch.column("doc_id")), batch.column("flags")
            for lo, hi, raw, at in text_slices(batch):
                starts, ends, first = wh.spans(raw, at)
                picked = []
                for i in range(lo, hi):
                    n = int(first[i - lo + 1] - first[i - lo])
                    f = flags[i].values.to_numpy(zero_copy_only=False)
                    f = f[(f & wanted) > 0] >> 2
                    if n < window or not len(f):
                        continue
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, np.clip(f - period + 1, 0, n), 1)
                    np.add.at(step, np.clip(f + 1, 0, n), -1)
                    near = np.flatnonzero(np.cumsum(step)[: n - window + 1] > 0)
                    picked.append((i, near, near + first[i - lo]))
                if not picked:
                    continue
                words = wh.word_hashes(raw, starts, ends)
                g = np.concatenate([x[2] for x in picked])
                if not len(g):
                    continue
                columns = [
                    wh.window_hashes(words, window)[g].view(np.int64),
                    wh.second_hashes(wh.word_hashes(raw, starts, ends, second=True), window)[g].view(np.int64),
                    np.repeat(ids[[x[0] for x in picked]], [len(x[1]) for x in picked]),
                    np.concatenate([x[1] for x in picked]).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "pos"])

    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What stays of each text; a window is cut only where its hash is met again (rows may share an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column("text"))
            data, found = raw.tobytes(), batch.column("found")
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].split()
                n, gone = len(words), 0
                if found[i].is_valid and n >= window:
                    pos = found[i].values.field("pos").to_numpy(zero_copy_only=False)
                    want = found[i].values.field("h1").to_numpy(zero_copy_only=False)
                    text = raw[at[i] : at[i + 1]]
                    starts, ends, _ = wh.spans(text, np.array([0, len(text)]))
                    own = wh.window_hashes(wh.word_hashes(text, starts, ends), window).view(np.int64)
                    ok = pos <= n - window
                    pos = pos[ok][own[pos[ok]] == want[ok]]
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, pos, 1)
                    np.add.at(step, pos + window, -1)
                    covered = np.cumsum(step)[:n] > 0
                    gone = int(covered.sum())
                    words = [words[j] for j in np.flatnonzero(~covered)]
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row of documents."""
    # the key is never null, so that all joins deal the texts by one and the same exchange
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    named = docs.where("doc_id is not null")
    ids = named.mapInArrow(_anchors(window, True), "h long, doc_id long")
    # grouped by more than the join's key, the shared side gets an exchange of its own: Spark can then split hot hashes
    shared = ids.groupBy("h", F.expr("h & 1").alias("odd")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("odd")
    anchors = named.mapInArrow(_anchors(window, False), "h long, doc_id long, pos int")
    hits = anchors.join(shared, "h").select("doc_id", F.expr("pos * 4 + if(doc_id < hi, 1, 0) + if(doc_id > lo, 2, 0)").alias("flag"))
    flags = keep(hits.groupBy("doc_id").agg(F.collect_list("flag").alias("flags")))
    near = docs.join(flags.withColumnRenamed("doc_id", "key"), "key")
    schema = "h1 long, h2 long, doc_id long, pos int"
    earliest = near.mapInArrow(_windows(window, 1), schema).groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"))
    later = near.mapInArrow(_windows(window, 2), schema)
    found = later.join(earliest, ["h1", "h2"]).where("lo < doc_id").select("doc_id", F.struct("pos", "h1").alias("w"))
    found = found.groupBy("doc_id").agg(F.collect_list("w").alias("found"))
    return docs.join(found.withColumnRenamed("doc_id", "key"), "key", "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


