"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Files hold segments, each a run of whole documents in ascending id order. One list for all of them has the token ids by falling
frequency over all documents; a token is the rank of its id in that list, in one to four bytes, so the 256 most
frequent ids take one byte. The lengths lie apart, four to a control byte. Decoding is numpy alone: a table turns each
control byte into four lengths, their running sum gives the places, and the list turns ranks into ids.

Texts are encoded once: their ids are written as they are (two bytes each, four for vocabularies above 65,536), counted, and
written anew as ranks; the first files are then deleted. Counts, list and ranks are as long as the vocabulary, whatever the input.

Documents are dealt by ranges of (id, hash of the text), into as many buckets as the bytes need, so a hot id is split. Segments
lie in Parquet rows: the writer's commit makes a file whole or absent when an executor is lost, any store can hold them, and
the global start of a document comes from the totals of the buckets (one number each).

Defined results: a null or empty text has the end id only; an empty table gives no rows; a text of any length is encoded whole
(one segment); null document ids come first; rows that share an id are ordered by the hash of their text, after which they are
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packed
from .common import SLICE_BYTES, drop_kept, keep, parts_for, text_slices
from .wordcache import Memory, distinct, gather, per_text

#: A segment is closed when it has as many ids or documents; a longer document is a segment of its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 16, 1 << 12

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned numbers below 2**32."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = (v[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        has = size > k
        if not has.any():
            break
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranking(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur by falling count (ties: the smaller first), and the place of every id in that list."""
    listed = np.flatnonzero(count)
    listed = listed[np.argsort(-count[listed], kind="stable")]
    place = np.zeros(len(count), np.uint32)
    place[listed] = np.arange(len(listed))
    return listed.astype("<u4"), place


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Characters below this are cut by table; fixed values: the kinds of characters.
LIMIT = 0x250
GAP, LETTER, NUMBER, OTHER, HARD = range(5)


#: Fixed value: the pattern that the table stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """The library's ids for words, runs without ASCII white space.

    White space is dropped by this tokenizer, so a text's ids are those of its words one after the other. A plain word (characters
    below LIMIT, no apostrophe, no special string) is cut by table into parts, as the vocabulary's pattern says: a run of
    letters, one number, a run of others. Only the distinct parts of a batch are looked up, and those not known yet go through the
    library's merges. Any other word goes through the whole library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json
        import re

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        said = json.load(open(path))
        split = said["pre_tokenizer"]["pretokenizers"][0] if said.get("pre_tokenizer", {}).get("type") == "Sequence" else {}
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or split["pattern"].get("Regex") != PATTERN:
            raise ValueError("a tokenizer that lower-cases and drops white space is expected")
        self.special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in said.get("added_tokens", [])) or b"(?!)")
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.letters = _byte_letters()
        suffix = said["model"]["end_of_word_suffix"]
        self.size = self.whole.get_vocab_size()
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in said["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.kind, self.lower = np.full(LIMIT + 1, HARD, np.uint8), np.zeros(LIMIT + 1, np.uint32)
        plain = re.compile("[!-&(-~¡-¬®-ɏ]").fullmatch  # no control characters, no-break space, apostrophe or soft hyphen
        for point in range(LIMIT):
            c = chr(point)
            if point == 0x20 or 0x09 <= point <= 0x0D:
                self.kind[point] = GAP
            elif plain(c) and len(c.lower()) == 1 and ord(c.lower()) < LIMIT:
                self.kind[point] = LETTER if regex.match(r"\p{L}", c.lower()) else NUMBER if regex.match(r"\p{N}", c.lower()) else OTHER
                self.lower[point] = ord(c.lower())
        self.parts, self.words = Memory(self._parts), Memory(self._words, most=200_000)

    def _parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        get = self.letters
        written = [p.decode() if p.isascii() else "".join([get[b] for b in p]) for p in parts]  # printable ASCII stands for itself
        got = self.merges.encode_batch_fast([" ".join(written[i : i + 64]) for i in range(0, len(written), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(g.ids, np.int32) for g in got])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(parts) or ends[-1] + 1 != len(ids):
            raise RuntimeError("each part must end in one end-of-word token")
        return ids, np.diff(ends, prepend=-1)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(got)), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts raw[at[i] : at[i + 1]], and how many each has."""
        data = raw.tobytes()
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            firsts, byte = at, None
        else:
            byte = np.flatnonzero((raw & 0xC0) != 0x80)  # where each character begins
            firsts = np.searchsorted(byte, at)
        low = np.minimum(points, LIMIT)
        kind = self.kind[low]
        cut = np.zeros(len(points) + 1, bool)
        cut[firsts] = True
        cut = cut[:-1]
        before = np.concatenate([[GAP], kind[:-1]]).astype(np.uint8)
        # words that hold a character which the table can't judge, or a special string
        bad = kind == HARD
        if b"<" in data:
            for m in self.special.finditer(data):
                bad[np.searchsorted(byte, m.start()) if byte is not None else m.start()] = True
        starts = np.flatnonzero((kind != GAP) & (cut | (before == GAP)))  # of words
        n_bad = np.concatenate([[0], np.cumsum(bad)])
        ends = np.flatnonzero((kind != GAP) & (np.append(cut[1:], True) | (np.append(kind[1:], GAP) == GAP))) + 1
        hard = n_bad[ends] > n_bad[starts]
        inside = np.zeros(len(points) + 1, np.int8)
        np.add.at(inside, starts[hard], 1)
        np.add.at(inside, ends[hard], -1)
        easy = (kind != GAP) & (np.cumsum(inside[:-1], dtype=np.int8) == 0)
        opens = easy & (cut | (before != kind) | (kind == NUMBER))
        where = np.flatnonzero(opens)  # of parts
        lowered = self.lower[low[easy]]
        wide = lowered >= 0x80
        text = lowered.astype("<u4").tobytes().decode("utf-32-le").encode()
        place = (np.cumsum(easy) - 1)[where]
        if wide.any():
            place = (np.cumsum(1 + wide) - 1 - wide)[place]
        keys, which = distinct(text, np.append(place, len(text)))
        flat, start, size = self.parts.of(keys)
        start, size = start[which], size[which]
        if hard.any():
            begin, stop = starts[hard], ends[hard]
            if byte is not None:
                edge = np.append(byte, len(raw))
                begin, stop = edge[begin], edge[stop]
            words = [data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            every, of = distinct(b"".join(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
            more, s, n = self.words.of(every)
            order = np.argsort(np.concatenate([where, starts[hard]]), kind="stable")
            start, size = np.concatenate([start, len(flat) + s[of]])[order], np.concatenate([size, n[of]])[order]
            flat, where = np.concatenate([flat, more]), np.concatenate([where, starts[hard]])[order]
        return gather(flat, start, size), per_text(size, np.diff(np.searchsorted(where, firsts)))


@lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def encode_texts(path: str, end_id: int, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts raw[at[i]:at[i+1]], each with its end id, and how many each has."""
    ids, n = _tokens(path).texts(raw, at)
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def _segments(path: str, end_id: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["bucket", "segment", "first_start", "n_ids", "doc_ids", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, segment, start, waiting = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal segment, start, waiting, held
            if held:
                ids, n, docs = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [d for h in held for d in h[2]]
                cuts = np.concatenate([[0], np.cumsum(n)])
                lo = 0
                while lo < len(n):
                    hi = min(len(n), lo + SEGMENT_DOCS, max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SEGMENT_IDS, "right")) - 1))
                    part = ids[cuts[lo] : cuts[hi]]
                    row = [[bucket], [segment], [start], [len(part)], [docs[lo:hi]], [n[lo:hi].tolist()], [part.astype(kind).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)
                    start, segment, lo = start + len(part), segment + 1, hi
                held, waiting = [], 0

        for batch in batches:
            for lo, hi, raw, at in text_slices(batch, limit=2 * SLICE_BYTES):
                ids, n = encode_texts(path, end_id, raw, at)
                held.append((ids, n, batch.column("doc_id").slice(lo, hi - lo).to_pylist()))
                waiting += len(ids)
                if waiting >= SEGMENT_IDS:
                    yield from close()
        yield from close()

    return run


def _counted(size: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = packed.zeros(1, size)
        for batch in batches:
            for ids in batch.column("ids"):
                total[0] += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=total.shape[1])
        yield from packed.packed(total)

    return run


def _coded(place: np.ndarray, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                control, data = pack(place[np.frombuffer(one.column("ids")[0].as_buffer(), kind)])
                columns = [*one.columns[:-1], pa.array([control], pa.binary()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*one.schema.names[:-1], "control", "data"])

    return run


SCHEMA = "bucket int, segment int, first_start long, n_ids long, doc_ids array<long>, n_tokens array<long>"
CODED = f"{SCHEMA}, control binary, data binary"


def write_tokens(documents: DataFrame, tokenizer_path: str, out: str, end_id: int = 2) -> str:
    """Write the ids of all documents below `out`, a folder that all executors share; returns `out`. The list of ids lies in
    `out`/ranks, the segments in `out`/segments."""
    spark = documents.sparkSession
    size = max(_tokens(tokenizer_path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    # a bucket is a range, lies whole in one partition and is one file; the range bounds are sampled, so no bucket is far above its share
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = docs.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    plain = keep(dealt.mapInArrow(_segments(tokenizer_path, end_id, kind), f"{SCHEMA}, ids binary"))
    # as many rows of counts as the cluster has cores, a few times over, however many files there are
    counted = plain.select("ids").coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(_counted(size, kind), packed.COUNTS)
    listed, place = ranking(packed.added(counted, 1, size)[0])
    spark.createDataFrame([(bytearray(listed.tobytes()),)], "ranks binary").coalesce(1).write.parquet(f"{out}/ranks")
    sent = spark.sparkContext.broadcast(place)
    plain.mapInArrow(lambda batches: _coded(sent.value, kind)(batches), CODED).write.parquet(f"{out}/segments")
    drop_kept(plain)
    return out


def _read(listed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                ids = listed[unpack(one["control"], one["data"], one["n_ids"])]
                n = np.array(one["n_tokens"], np.int64)
                ends = np.cumsum(n)
                data = ids.astype("<u4").tobytes()
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([one["bucket"]] * len(n), pa.int32()), pa.array(one["doc_ids"], pa.int64()), pa.array(one["first_start"] + ends - n), pa.array(n), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "within", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit numbers)."""
    files = spark.read.schema(CODED).parquet(f"{path}/segments")
    row = spark.read.schema("ranks binary").parquet(f"{path}/ranks").first()  # one list, at most as long as the vocabulary
    sent = spark.sparkContext.broadcast(np.frombuffer(row.ranks, "<u4"))
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each bucket
    bases = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(lambda batches: _read(sent.value)(batches), "bucket int, doc_id long, within long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "bucket").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
