"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads each character once. At every position the output links lead through all pieces that end
there, longest first, and each relaxes the best score of the position: that of its start plus the piece's own. For a unigram
model the own score is the piece's; for a merge-based model it is 0 where the piece stands in merge order with the best piece
before it (see Consistency) and minus infinity elsewhere. There one piece alone reaches 0 at each position, and the result
equals the library's. A character that no piece covers becomes its bytes, or the unknown id.

Texts are cut first where no piece can span (see segments), and a distinct segment is encoded once for each batch or less often.

Decoding joins the pieces, turns byte pieces back into bytes and drops the prefix space: the text comes back
exactly (but for U+2581, which the format itself reads as a space, and for unknown ids without byte fallback).

Defined results: a null or empty text has no ids and decodes to the empty text; a null list of ids likewise; an empty table
gives no rows; a text of any length is encoded whole (segments over wordcache.LONG bytes aren't kept in memory); null document ids
and repeated rows are encoded like any other; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_model
from .common import SLICE_BYTES, py_texts, text_slices
from .piece_model import BYTE, CONTROL, SPACE, Consistency, PieceModel
from .segments import segments
from .wordcache import Memory, distinct, per_text


class Automaton:
    """Aho-Corasick over the pieces. step[node] maps characters; fail[node] is the longest proper suffix;
    piece[node] is the piece that ends at the node (or -1) and output[node] the next node on the suffix chain with one."""

    def __init__(self, model: PieceModel):
        self.step: list[dict[str, int]] = [{}]
        self.piece, self.length = [-1], [0]
        for text, i in model.ids.items():
            node = 0
            for c in text:
                to = self.step[node].get(c)
                if to is None:
                    to = self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.piece.append(-1)
                    self.length.append(self.length[node] + 1)
                node = to
            self.piece[node] = i
        self.fail, self.output = [0] * len(self.step), [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            node = queue.popleft()
            for c, to in self.step[node].items():
                back = self.fail[node]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[to] = self.step[back].get(c, 0) if node else 0
                queue.append(to)
            back = self.fail[node]
            self.output[node] = back if self.piece[back] >= 0 else self.output[back]
        #: The first node on the output chain of each node, itself included.
        self.first = [x if self.piece[x] >= 0 else self.output[x] for x in range(len(self.step))]


#: Text is encoded in parts of about this many bytes: the workers of an executor share what its JVM leaves, and a part's arrays take
#: some 20 times its size.
PART_BYTES = SLICE_BYTES // 2
NEVER = float("-inf")


class PieceScores(dict):
    """own[last * stride + piece] of a unigram model: the piece's score, whatever stands before (stride 0)."""

    stride, most = 0, float("inf")

    def __init__(self, model: PieceModel):
        super().__init__(enumerate(model.scores))


class MergeScores(dict):
    """own[last * stride + piece] of a merge-based model: 0 if piece may follow last (-1: nothing that merges), else NEVER."""

    stride, most = 1 << 32, 0.0

    def __init__(self, model: PieceModel, entries: int = 600_000):
        super().__init__()
        self.rule, self.entries = Consistency(model), entries

    def __missing__(self, key: int) -> float:
        if len(self) > self.entries:  # bounded memory; what is needed comes back soon
            self.clear()
        value = self[key] = 0.0 if self.rule.judge(*divmod(key, self.stride)) else NEVER  # one of two objects; the rule keeps no copy
        return value


class Codec:
    def __init__(self, model: PieceModel):
        self.model, self.auto = model, Automaton(model)
        self.own = MergeScores(model) if model.bpe else PieceScores(model)
        self.unknown_score = 0.0 if model.bpe else min(model.scores, default=0.0) - 10.0
        self.bytes_of = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if i == model.unknown else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]

    def pieces_of(self, text: str) -> list[int]:
        """Ids for text, whose spaces are SPACE already."""
        last, back = self.best_paths(text)
        i = len(text)
        out: list[list[int]] = []
        while i:
            out.append([last[i]] if last[i] >= 0 else self.model.unknown_ids(text[i - 1]))
            i = back[i]
        return [x for part in reversed(out) for x in part]

    def best_paths(self, text: str) -> tuple[list[int], list[int]]:
        """For each position the last piece of the best path to it (-1: an unknown character) and where it starts."""
        auto, own, stride, most = self.auto, self.own, self.own.stride, self.own.most
        step, fail, output, piece, length, first = auto.step, auto.fail, auto.output, auto.piece, auto.length, auto.first
        n, low = len(text), NEVER
        best, last, back = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        node = i = 0
        for c in text:
            i += 1
            to = step[node].get(c)
            while to is None and node:
                node = fail[node]
                to = step[node].get(c)
            node = to or 0
            at, top, single = first[node], low, False
            while at:
                size, k = length[at], piece[at]
                start = i - size
                single = single or size == 1
                score = best[start] + own[last[start] * stride + k]
                if score > top:
                    top, last[i], back[i] = score, k, start
                    if score >= most:
                        break  # no piece can do better
                at = output[at]
            if top == low or top < best[i - 1] + self.unknown_score and not single:
                top, back[i] = best[i - 1] + self.unknown_score, i - 1
                last[i] = -1
            best[i] = top
        return last, back

    def decode(self, ids: list[int] | np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if self.model.dummy_prefix and data[:1] == " " else data


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Codec, Memory]:
    made = Codec(piece_model.load(path))

    def encode(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [made.pieces_of(k.decode().replace(" ", SPACE)) for k in keys]
        return np.array(list(chain.from_iterable(got)), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    return made, Memory(encode)


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and how many each has."""
    data, at, counts = segments(path).of(texts)
    keys, which = distinct(data, at)
    ids, sizes = codec(path)[1].joined(keys, which)
    return ids, per_text(sizes, counts)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch, limit=PART_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, sizes = encode_texts(path, py_texts(part.column("text")))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*(c for c in part.schema.names if c != "text"), "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column("ids")
                offsets = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                texts = [made.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return run


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, ids)."""
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decode(model_path), "doc_id long, ids array<int>, decoded string")


def _both(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = codec(path)
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch, limit=PART_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, sizes = encode_texts(path, py_texts(part.column("text")))
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                at = [*zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [part.column("doc_id"), pa.array([raw[4 * a : 4 * b] for a, b in at], pa.binary()), pa.array([made.decode(ids[a:b].tolist()) for a, b in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return run


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row, as decode(encode(...)) in one pass; ids are little-endian unsigned 32-bit numbers."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_both(model_path), "doc_id long, ids binary, decoded string")


def with_digests(decoded: DataFrame) -> DataFrame:
    """n_tokens, crc32 over the ids' bytes, and the decoded text's length and SHA-256, of rows of round_trip."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
