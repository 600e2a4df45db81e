"""Token counts by a finite-state transducer compiled from a piece model.

For merge-based models the segmentation of a text's prefix ends in exactly one piece, found from the pieces that
end there and the piece before each (see Consistency). So reading a character is a transition of a deterministic
transducer: its state holds, for each start from which the trie of pieces is still being followed, the trie node,
the piece that ends at that start and how many tokens that prefix has relative to now. Each transition is
annotated with the change of the token count. The machine is compiled lazily: a (state, character) pair is
determinised when it is first met, then read from a table.

Between two characters that no piece holds side by side (before most spaces, round a line feed) the state doesn't depend on
what was read. Texts are cut there, and the map of such a segment from entry states to (exit state, count) is constant:
segments compose by adding (a prefix sum over all segments of a batch), and a segment is read once for each batch or less often.
A long run without such a place is cut into chunks of fixed length; the map of each over its live entry states is made
without knowing the others, and a parallel prefix scan composes them.

Counts equal the library's encoding without begin and end tokens. Defined results: a null or empty text has no
tokens and no bytes; an empty table gives no rows; a text of any length is counted whole (segments over wordcache.LONG bytes aren't
kept in memory); null ids and repeated rows are counted like any other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_model
from .common import SLICE_BYTES, py_texts, text_slices
from .piece_model import SPACE, Consistency, PieceModel
from .segments import segments
from .wordcache import Memory, distinct, per_text

#: A run of up to this many characters is read at once; longer ones are cut into chunks of this length.
CHUNK = 512
#: Characters before a chunk from which its entry states are foreseen, and from how many places there the reading starts.
LOOK_BACK, LOOK_STARTS = 64, 4


class Transducer:
    """Lazily determinised; state 0 is the start."""

    def __init__(self, model: PieceModel, most_states: int = 200_000):
        self.model, self.rule, self.most_states = model, Consistency(model), most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for piece, i in model.ids.items():
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.known, self.table = [start], {start: 0}, [{}]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        live, count = [], None
        for node, last, relative in self.states[state]:
            to = self.children[node].get(char)
            if to is None:
                continue
            piece = self.ends[to]
            if piece >= 0 and count is None and self.rule.fits(last, piece):
                count, ending = relative + 1, piece
            live.append((to, last, relative))
        if count is None:  # no piece holds the character
            count, ending, live = len(self.model.unknown_ids(char)), -1, []
        after = tuple([(n, last, r - count) for n, last, r in live if self.children[n]] + [(0, ending, 0)])
        to = self.known.get(after)
        if to is None:
            to = self.known[after] = len(self.states)
            self.states.append(after)
            self.table.append({})
        self.table[state][char] = to, count
        return to, count

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The exit state and the number of tokens that reading text adds."""
        table, total = self.table, 0
        for c in text:
            step = table[state].get(c)
            if step is None:
                step = self._compile(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, text: str) -> int:
        """Tokens of one run that stands alone; a long one by a prefix scan over the state maps of its chunks."""
        if len(self.states) > self.most_states:
            self.reset()
        if len(text) <= CHUNK:
            return self.run(text)[1]
        return prefix_scan(self.chunk_maps([text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]))[-1][0][1]

    def chunk_maps(self, parts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each chunk the map of its live entry states to (exit state, count).

        Every chunk is read on its own from the states in which a reader may stand after LOOK_BACK characters before it,
        whatever came earlier. Where the neighbour on the left leaves in a state that this missed, the chunk is read from that
        state too, until each map knows every exit of the map before it."""
        entries = [{0}, *({self.run(p[-LOOK_BACK:][k:])[0] for k in range(LOOK_STARTS)} for p in parts[:-1])]
        maps = [{e: self.run(p, e) for e in sorted(live)} for p, live in zip(parts, entries, strict=True)]
        todo = list(range(1, len(parts)))
        while todo:
            again = []
            for i in todo:
                missed = {x for x, _ in maps[i - 1].values()} - maps[i].keys()
                if missed:
                    maps[i] |= {e: self.run(parts[i], e) for e in sorted(missed)}
                    again.append(i + 1)
            todo = [i for i in again if i < len(parts)]
        return maps


def composed(first: dict[int, tuple[int, int]], second: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The map of two neighbouring runs, for every entry state of the first."""
    return {e: (second[x][0], n + second[x][1]) for e, (x, n) in first.items()}


def prefix_scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
    """The composition of maps[0] to maps[i] for each i, by doubling: after step k every map spans 2**k chunks, and all
    compositions of a step are independent of each other."""
    out, width = list(maps), 1
    while width < len(out):
        out = [composed(out[i - width], out[i]) if i >= width else out[i] for i in range(len(out))]
        width *= 2
    return out


@lru_cache(maxsize=2)
def _memory(path: str) -> tuple[PieceModel, Transducer, Memory]:
    model = piece_model.load(path)
    if not model.bpe:
        raise ValueError("token counts need a merge-based model")
    machine = Transducer(model)
    return model, machine, Memory(lambda keys: (np.fromiter((machine.count(k.decode().replace(" ", SPACE)) for k in keys), np.int32, len(keys)), np.ones(len(keys), np.int64)))


def count_texts(path: str, texts: list[str]) -> np.ndarray:
    """Tokens of each text: a segment's state map is constant (nothing spans its ends), so segments compose by a prefix sum."""
    memory = _memory(path)[2]
    data, at, counts = segments(path).of(texts)
    keys, which = distinct(data, at)
    flat, starts, _ = memory.of(keys)
    return per_text(flat[starts].astype(np.int64)[which], counts)


def _batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, at in text_slices(batch, limit=2 * SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                size = np.diff(at)
                count = count_texts(path, py_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(count)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; model_path: a .model file that every executor has."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_batches(model_path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
