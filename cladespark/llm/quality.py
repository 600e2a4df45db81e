"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted: one over every
document (the raw corpus), one over every document labelled good (the target). A document's score is
the mean over its n-grams of log p_target - log p_raw, so it doesn't depend on length. The threshold is fixed from all
labelled documents and then holds for every document.

What comes to the driver is bounded by the number of buckets, never by the corpus or its labels: a task adds up its
counts and emits them as a few packed rows (at most 1 MB), which are added up in two levels; the threshold's rank is found
by counts of 16 bits of the scores at a time. Labels meet texts by a merge join, which deals the texts by id once; nothing that grows with the labels is broadcast.

Defined results: a null or empty text has no words and fails the base rules; an empty table gives no rows; a long text is counted
and scored whole, in blocks; without good labels, or without labels of poor documents, only the base rules decide; labels with a null id are ignored, and of several labels for one id the
poorest counts; repeated rows and null ids are judged like any other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from . import wordhash as wh
from .common import keep, text_slices

#: Bits of the bucket number.
BUCKET_BITS = 16
#: Share of the good labelled documents that the threshold may reject.
REJECT_GOOD = 0.0005
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs of texts with n words each, and the text of each."""
    text = np.repeat(np.arange(len(n)), n)
    pairs = wh.window_hashes(words, 2)
    inside = text[1:] == text[:-1] if len(text) > 1 else np.zeros(0, bool)
    grams = np.concatenate([words, pairs[inside] if len(pairs) else pairs]) >> np.uint64(64 - BUCKET_BITS)
    return grams.astype(np.int64), np.concatenate([text, text[1:][inside]]) if len(text) > 1 else text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed counts of a whole task."""
    flat = packed.zeros(1, 1 << BUCKET_BITS)
    for batch in batches:
        for _, _, raw, at in text_slices(batch):
            starts, ends, first = wh.spans(raw, at)
            grams, _ = _grams(wh.word_hashes(raw, starts, ends), np.diff(first))
            flat[0] += np.bincount(grams, minlength=flat.shape[1])
    yield from packed.packed(flat)


def _counts(docs: DataFrame) -> np.ndarray:
    return packed.added(docs.select("text").mapInArrow(_count, packed.COUNTS), 1, 1 << BUCKET_BITS)[0]


def _repeat_words(words: np.ndarray) -> int:
    h = wh.window_hashes(words, REPEAT_WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + REPEAT_WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def _score(ratio: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in text_slices(batch):
                starts, ends, first = wh.spans(raw, at)
                n = np.diff(first)
                words = wh.word_hashes(raw, starts, ends)
                grams, text = _grams(words, n)
                m = hi - lo
                sums, sizes = np.bincount(text, ratio[grams], m), np.bincount(text, minlength=m)
                inside = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(((raw & 0xC0) != 0x80) & ~wh._SPACE[raw], out=inside[1:])
                symbols = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(_SYMBOL[raw], out=symbols[1:])
                data = raw.tobytes()
                lines = [[x for x in data[a:b].split(b"\n") if x.strip()] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [n, np.diff(inside[at]), np.diff(symbols[at]), np.array([len(x) - len(set(x)) for x in lines]), np.array([_repeat_words(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, m), batch.column("text_key").slice(lo, m), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(sums / np.maximum(sizes, 1))], names)

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the whole number `rank` beside their score, in the same order."""
    for batch in batches:
        bits = (np.asarray(batch.column("score")) + 0.0).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("score"), pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))], ["quality", "score", "rank"])


def threshold(fit: DataFrame, reject: float = REJECT_GOOD) -> float:
    """The cut for scores: as many poor documents below it as can be while at most `reject` of the good ones are, and in the
    middle of the gap below that. fit: (quality, score) of one row for each labelled document, quality 1 or 0."""
    fit = keep(fit.mapInArrow(_ranked, "quality int, score double, rank long"))
    sizes = {r.quality: r.n for r in fit.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return float("-inf")
    left, among = int(reject * sizes[1]), fit.where("quality = 1")
    for shift in (48, 32, 16, 0):  # the part of the ranks, by ever more leading bits, that holds the good score after `left` others
        part = F.shiftright("rank", shift)
        for row in among.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("score").alias("score")).orderBy("part").collect():  # at most 2^16
            if left < row.n:
                break
            left -= row.n
        among = among.where(part == row.part)
    below = fit.where("quality = 0").where(F.col("score") < F.lit(row.score)).agg(F.max("score").alias("score")).first().score
    return row.score if below is None else (row.score + below) / 2


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, the base counts, base_failed, score and kept of every row of documents."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = keep(known.where("quality in (0, 1)"))
    counts = np.stack([_counts(docs), _counts(docs.select("doc_id", "text").join(known.where("quality = 1").hint("merge"), "doc_id"))])
    p = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1]))
    ratio = (p[1] - p[0]) if counts[1].any() else np.zeros(counts.shape[1])
    sent = spark.sparkContext.broadcast(ratio)
    schema = "doc_id long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    scored = keep(docs.mapInArrow(lambda batches: _score(sent.value)(batches), schema))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    scored = scored.withColumn("base_failed", failed)
    least = scored.where("not base_failed and doc_id is not null").groupBy("doc_id").agg(F.min("score").alias("score"))
    cut = threshold(least.join(known, "doc_id").select("quality", "score"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
