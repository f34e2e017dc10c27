"""The corpus pipeline: quality classifier, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return documents' columns as they came.

Null and empty texts are scored like other texts; those that stay are copies of each other, match no
benchmark passage and are packed as an end id alone. Rows without doc_id stay through near-dedup. Of
repeated rows, and of ties, the row with the least doc_id stays. Long texts are read whole. Extra
columns, of any name, are kept up to packing. Empty tables give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanforge.llm import decontam, neardup, packing, quality
from scanforge.llm.common import read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5, by a classifier fitted on the labelled ones."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels"), "quality"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates."""
    return neardup.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_first_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("packing", pack_tokens),
]

#: The model, the sketches and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
