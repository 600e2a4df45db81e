"""Tables of counts that tasks make, added up as packed rows.

A task emits its counts as rows of SLICE numbers, one for each kind and slice that has any; the rows are added up in two levels. What
comes to the driver is bounded by the table's length, never by the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Counts in a row; sums of tasks that are made side by side before the last sum.
SLICE, LANES = 1 << 12, 4
COUNTS = "kind int, slice int, lane int, counts binary"


def slices(length: int) -> int:
    return -(-length // SLICE)


def zeros(kinds: int, length: int) -> np.ndarray:
    """Counts of no input: as many as fill whole slices."""
    return np.zeros((kinds, slices(length) * SLICE), np.int64)


def packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a task's counts (kinds x length)."""
    cut = counts.reshape(len(counts), -1, SLICE)
    lane = TaskContext.get().partitionId() % LANES
    yield from _rows({(k, s): cut[k, s] for k, s in zip(*(x.tolist() for x in np.nonzero(cut.any(axis=2))), strict=True)}, lane)


def _rows(total: dict[tuple[int, int], np.ndarray], lane: int) -> Iterator[pa.RecordBatch]:
    if total:
        columns = [pa.array([k for k, _ in total], pa.int32()), pa.array([s for _, s in total], pa.int32()), pa.array([lane] * len(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "slice", "lane", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows by kind and slice; a task holds one sum for each of its keys."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, at, counts in zip(batch.column("kind").to_pylist(), batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), "<i8")
            if (kind, at) in total:
                total[kind, at] += more
            else:
                total[kind, at] = more.copy()
    yield from _rows(total, 0)


def added(counted: DataFrame, kinds: int, length: int) -> np.ndarray:
    """The sum (kinds x length, up to whole slices) of the rows that all tasks packed."""
    n = slices(length)
    lanes = counted.repartition(LANES * n, "lane", "slice").mapInArrow(_add, COUNTS)
    out = zeros(kinds, length).reshape(kinds, n, SLICE)
    for row in lanes.repartition(n, "slice").mapInArrow(_add, COUNTS).toLocalIterator():  # at most a row for each kind and slice
        out[row.kind, row.slice] += np.frombuffer(row.counts, "<i8")
    return out.reshape(kinds, -1)
