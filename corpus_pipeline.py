"""A corpus pipeline over `documents`: quality rules, near-dedup, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir); run() writes its result as Parquet to the shared folder and reads it as the next
one's docs. Stages cut by a hash of the text, near-dedup by one of id and text, so rows that share an id or have none
are judged by their own text; one row stays of each near-duplicate class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import decontam, jaccard, pii, quality, sentencepiece_codec
from cladespark.llm.common import keep, table
from cladespark.llm.registry import vocabulary


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose text hash isn't in keys (text_key)."""
    return docs.join(keys.distinct(), F.xxhash64(docs["text"].cast("string")) == keys["text_key"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _without(docs, quality.judge(docs, table(spark, sf_dir, "labels")).where("not kept").select("text_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the least id, of each class of near duplicates (five-word shingles, similarity 0.8 or more)."""
    first = keep(jaccard.first_rows(docs).select(F.col("k").alias("row_key"), "n"))
    chosen = docs.withColumn("row_key", jaccard.row_key(docs)).join(first, "row_key").select(*(docs[c] for c in docs.columns), "row_key", "n")
    return chosen.where("n = 1").union(chosen.where("n > 1").dropDuplicates(["row_key"])).drop("row_key", "n")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, wherever it stands and however short it is."""
    texts = docs.select(F.xxhash64(docs["text"].cast("string")).alias("doc_id"), "text")  # a text is judged under its own hash
    found = decontam.leaks(texts, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("text_key")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids (little-endian unsigned 32-bit numbers), with their number and a digest of the text decoded from them."""
    both = sentencepiece_codec.round_trip(docs, vocabulary("piece_bpe_32k.model"))
    return both.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]

#: No SQL: hashing, fitted thresholds and tokenization can't be expressed; tests/llm/test_pipeline.py holds run() to a version in plain Python, on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
