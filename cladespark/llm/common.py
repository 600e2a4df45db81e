"""Helpers shared by the operators: table access, tables kept between jobs, order buckets, Arrow text access."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is handled in slices of about this many bytes, so working arrays stay small whatever the batch holds.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session uses a temporary folder, set once, and a cluster its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_cladespark"
        else:
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="cladespark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table written by keep() that no later plan reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def order_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending cut points that deal the rows of df into about `buckets` equal runs of key.

    At most `buckets - 1` numbers come to the driver, whatever the input."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, at, 10 * buckets).alias("q")).first()
    return sorted({int(x) for x in row.q}) if row and row.q else []


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key, by binary search in generated code; null counts as the least."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(search(0, len(bounds))) if bounds else F.lit(0)


def n_buckets(spark: SparkSession, least: int = 64, most: int = 1024) -> int:
    return max(least, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def parts_for(df: DataFrame, part_bytes: int = 128 << 20, most: int = 50_000) -> int:
    """How many partitions a sort of df is dealt into: the session's, or more, so that each has about part_bytes of the input
    files, up to `most` (beyond that partitions grow, and the sort spills). The size is the planner's estimate, so nothing is read;
    where it has none (rows that aren't from files), the session's number holds."""
    size, unknown = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), (1 << 63) - 1
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size // part_bytes)) if size < unknown else 1)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) of about `limit` bytes each (one long text alone), with their bytes and offsets."""
    raw, at = texts_of(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def py_texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]
