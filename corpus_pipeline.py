"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Every stage takes a table with the columns of ``documents`` and returns those
of its rows that stay, with all columns (the last: the packed pieces).  Null
texts count as empty; rows are judged one by one, by id and text, so rows that
share an id or have none lose nothing through one another; of rows that repeat
both, exact dedup leaves one; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontaminate, exact_dedup, jaccard, quality, tokens
from recollect.sources.scratch import drop_path, mark, scratch, sweep


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good text; very long and empty ones are scored like others."""
    return quality.quality(docs).filter("quality_score >= 0.5").select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; empty texts are one text."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id; texts without words and rows without an id stay."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; all of them where the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids; an empty text is its end id."""
    pieces = tokens.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, added=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: The label model and the min-hash draws can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what a stage needed meanwhile is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        start, path = mark(), scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, start, keep=(path,))
        if before:
            drop_path(spark, before)
        before = path
    return docs
