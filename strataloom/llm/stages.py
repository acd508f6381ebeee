"""The stages of the corpus pipeline; each maps documents to documents by one operator.

All stages accept null texts, null ids, empty tables and further columns under
any name but those of the documents table, and keep every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from . import mixing, near_dup, sentencepiece
from . import quality_classifier as classifier
from .shared import packed, unpacked
from .tokenizer_files import PIECES


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. Repeated rows share one verdict."""
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows the text, a null text stays null."""
    out = lines.drop_repeated_lines(packed(docs, doc_id="doc_id", text="text"))
    text = F.when(F.col("text").isNotNull(), F.col("_text"))
    length = F.when(F.col("_n_dropped") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    return unpacked(out, docs.columns, text=text, **({"n_chars": length} if length is not None else {}))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id."""
    gone = near_dup.classes_of(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    kept = packed(docs, i=F.col("doc_id").cast("long")).join(gone, F.col("i") == F.col("gone"), "left_anti")
    return unpacked(kept, docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; without words (null, empty) once."""
    return mixing.mix(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids`` in place of their text, and ``decoded_sha256``, the digest of the text that the ids decode to.

    Null and empty texts have no ids; repeated rows get a row each. Columns of the
    documents named as those added are left out.
    """
    return sentencepiece.encode(docs, sentencepiece.load(PIECES), digests=True)
