"""Weighted site patterns over a stream of alignment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.alignment import compress


def running_patterns(columns: DataFrame) -> DataFrame:
    """A streaming aggregation of columns to weighted patterns: the batch operator as it is, whose state is the pattern table.

    Write it in `update` or `complete` mode; the weights are exact after every batch, as each column counts once."""
    if not columns.isStreaming:
        raise ValueError("a streaming DataFrame is expected")
    return compress(columns)
