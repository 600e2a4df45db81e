"""Alignments and trees as DataFrames: whole files are read by Spark (any store it knows) and parsed in tasks.

`register(spark)` also makes the formats `phylip`, `fasta` and `newick` known to spark.read and, for the first two, to
df.write, through Python data sources over local paths.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import formats

SEQUENCES = "file string, taxon_id int, taxon string, seq string"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def read_alignment(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, taxon_id, taxon, seq) of all files at path; kind: `phylip` or `fasta`. A malformed file fails the query."""
    parse: Callable = {"phylip": formats.parse_phylip, "fasta": formats.parse_fasta}[kind]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(f, *row) for f, text in zip(frame["file"], frame["value"], strict=True) for row in parse(text)], columns=["file", "taxon_id", "taxon", "seq"])

    return _whole(spark, path).mapInPandas(run, SEQUENCES)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, newick): one row per tree, trees may span lines."""
    rows = _whole(spark, path).select("file", F.posexplode(F.split("value", ";")).alias("pos", "newick")).where(r"newick rlike '\\S'")
    return rows.select(F.xxhash64("file", "pos").alias("tree_id"), "file", "pos", F.concat(F.trim(F.regexp_replace("newick", r"\s+", " ")), F.lit(";")).alias("newick"))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, model, asc, freq_mode, name, regions) of a partition file."""
    text = "\n".join(r.value for r in _whole(spark, path).collect())  # one small file
    rows = [(s["ord"], s["model"], s["asc"], s["freq_mode"], s["name"], s["regions"]) for s in formats.parse_partitions(text)]
    return spark.createDataFrame(rows, "ord int, model string, asc boolean, freq_mode string, name string, regions array<struct<start:int,end:int,stride:int>>")


def write_alignment(sequences: DataFrame, path: str, kind: str) -> None:
    """One text file per partition of rows; an alignment goes to one file, in order of taxon_id, as the formats ask."""
    width = F.length("seq")
    if kind == "fasta":
        lines = sequences.orderBy("taxon_id").select(F.concat(F.lit(">"), "taxon", F.lit("\n"), "seq").alias("value"))
    else:
        head = sequences.agg(F.concat(F.count("*").cast("string"), F.lit(" "), F.max(width).cast("string")).alias("value")).withColumn("o", F.lit(0))
        lines = head.union(sequences.select(F.concat("taxon", F.lit(" "), "seq").alias("value"), F.col("taxon_id").alias("o"))).orderBy("o").select("value")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_blocks(sequences: DataFrame, path: str, kind: str) -> None:
    """One file for each block of an alignment, from (block, taxon_id, taxon, seq) with the block's sequences, so that no task holds
    more than a block; read_alignment reads the folder."""
    rows = sequences.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("taxon_id", "taxon", "seq"))).alias("rows"))  # a row for each taxon
    if kind == "fasta":
        text = F.expr("array_join(transform(rows, r -> concat('>', r.taxon, '\n', r.seq)), '\n')")
    else:
        text = F.expr("concat(size(rows), ' ', length(rows[0].seq), '\n', array_join(transform(rows, r -> concat(r.taxon, ' ', r.seq)), '\n'))")
    rows.select("block", text.alias("value")).write.mode("overwrite").partitionBy("block").text(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else, on a cluster, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="cladespark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class _Files(DataSourceReader):
    def __init__(self, path: str, parse: Callable[[str], list[tuple]]):
        self.path, self.parse = path, parse

    def partitions(self) -> list[InputPartition]:
        names = [os.path.join(self.path, x) for x in sorted(os.listdir(self.path)) if x[0] not in "._"] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(x) for x in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value) as f:
            yield from self.parse(f.read())


@dataclass
class _Part(WriterCommitMessage):
    """A file of one task's rows in order, and how many rows and characters there are."""

    file: str
    rows: int
    width: int


class _Writer(DataSourceWriter):
    """Tasks write their rows to hidden files; the commit merges them, a row of each at a time, to one alignment."""

    def __init__(self, path: str, head: Callable[[int, int], str], line: Callable[[str, str], str]):
        self.path, self.head, self.line = path, head, line

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        rows = sorted((r["taxon_id"], r["taxon"], r["seq"]) for r in iterator)
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        with open(file, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        return _Part(file, len(rows), max((len(r[2]) for r in rows), default=0))

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        name = uuid.uuid4().hex
        with ExitStack() as files, open(os.path.join(self.path, f".{name}.tmp"), "w") as out:
            out.write(self.head(sum(m.rows for m in parts), max((m.width for m in parts), default=0)))
            each = [map(json.loads, files.enter_context(open(m.file))) for m in parts]
            out.writelines(self.line(n, s) for _, n, s in heapq.merge(*each))
        if any(m.rows for m in parts):
            os.replace(os.path.join(self.path, f".{name}.tmp"), os.path.join(self.path, f"alignment-{name}"))
        else:
            os.remove(os.path.join(self.path, f".{name}.tmp"))
        self.abort(parts)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class PhylipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "phylip"

    def schema(self) -> str:
        return "taxon_id int, taxon string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], formats.parse_phylip)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], lambda n, width: f"{n} {width}\n", lambda name, seq: f"{name} {seq}\n")


class FastaSource(PhylipSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], formats.parse_fasta)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], lambda n, width: "", lambda name, seq: f">{name}\n{seq}\n")


class NewickSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newick"

    def schema(self) -> str:
        return "pos int, newick string"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], lambda text: [(i, x.strip() + ";") for i, x in enumerate(text.split(";")) if x.strip()])


def register(spark: SparkSession) -> None:
    for source in (PhylipSource, FastaSource, NewickSource):
        spark.dataSource.register(source)
