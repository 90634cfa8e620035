"""The corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takerank.llm import bpe, decontaminate, near_dedup, pii, quality
from takerank.llm.cluster import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that the rules reject go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms."""
    return pii.without_personal_data(docs, pii.session_key(spark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text; every text is decoded again and compared while it is encoded."""
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: Byte-level BPE cannot be written in SQL; tests/llm/test_pipeline.py holds all stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again by the next.

    A stage's table is deleted when the next one is written; that of the last stage but one stays, as the
    result reads it. Null ids go through as they are; null texts fall to the quality rules; empty tables
    give an empty result. Columns beside those of documents are carried along up to the last stage.
    """
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.stored(stage(spark, docs, sf_dir), name)
        work.clear(name)
    return STAGES[-1][1](spark, docs, sf_dir)
