"""A corpus pipeline of five operators: quality, line dedup, near dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, bpe, decontaminate, lines, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    return quality.keep_good(docs, _frames.table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence left of each group of repeated or similar lines; n_chars follows the text."""
    cut = lines.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash, as of op6, and by MinHash, compared by 5-word shingles of a Jaccard similarity of 0.8."""
    return simhash.drop_set_duplicates(docs).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, _frames.table(spark, sf_dir, "benchmark"), "documents").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of what is left."""
    return bpe.digests(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", leak_stage), ("tokenize", token_stage)]

#: the learnt model and the hashes have no SQL form; tests/llm hold line dedup, near dedup, decontamination and tokens against brute force, the classifier against held-out labels
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents. Stages are written below spark.checkpoint.dir; a stage's input goes once its output is written, the last output stays."""
    base = f"{_frames.ready(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        where = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(where)
        if before:
            _frames.remove(spark, before)
        docs, before = spark.read.parquet(where), where
    return docs
