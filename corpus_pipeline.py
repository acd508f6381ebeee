"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept. ``run`` writes every stage's result to the shared folder and reads it
back, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import stages
from strataloom.llm.shared import forget, written

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("line_dedup", stages.line_dedup),
    ("minhash_near_dedup", stages.minhash_near_dedup),
    ("source_mixing", stages.source_mixing),
    ("sentencepiece_encoding", stages.sentencepiece_encoding),
]

#: The classifier's trees and the seeded rounding have no SQL form; tests hold each stage against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
