"""Readers: explicit schemas, one row per record; bad files give no rows where the format allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, text string, source_file string, page_number int, section_title string, chunk_type string, word_count int"
ENTITIES_RAW = "nome_entita string, tipo_entita string, descrizione_entita string, source_chunk_id string, source_page_number int, source_section_title string"
RELATIONS_RAW = "soggetto string, predicato string, oggetto string, contesto_relazione string, source_chunk_id string, source_page_number int, source_section_title string"
ENTITIES_CLUSTERED = "nome_entita_cluster string, tipo_entita_cluster string, membri_cluster array<string>, tipi_membri_cluster array<string>, descrizioni_aggregate array<string>, fonti_aggregate_chunk_id array<string>, fonti_aggregate_pagina array<int>, fonti_aggregate_sezione array<string>, conteggio_occorrenze_totale bigint, motivazione_clustering string, membri_ids_originali array<int>"
RELATIONS_CLUSTERED = "soggetto_cluster string, predicato_cluster string, oggetto_cluster string, contesti_aggregati array<string>, fonti_aggregate_chunk_id array<string>, fonti_aggregate_pagina array<int>, fonti_aggregate_sezione array<string>, predicati_originali_cluster array<string>, conteggio_occorrenze_totale bigint, motivazione_clustering string, membri_ids_originali array<int>"
GOLDEN = "question_id string, question string, ideal_answer string, required_context_chunk_ids array<string>, question_type string, difficulty string"
EVALUATION = "user_input string, retrieved_contexts string, response string, reference string, faithfulness double, answer_relevancy double, context_precision double, context_recall double"
INTERACTIONS = "timestamp string, user_question string, graph_context_length int, text_context_length int, answer_length int, answer string, context_valid boolean"
PAGES = "source_file string, page_number int, text string, error string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays or lines; a malformed file gives no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CHUNKS)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GOLDEN)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation run's CSV: quoted fields may span lines, empty metrics are null."""
    return spark.read.schema(EVALUATION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def vocabulary(clustered: DataFrame) -> DataFrame:
    """Distinct non-empty cluster names in code-point order."""
    return clustered.where(F.length(F.trim("nome_entita_cluster")) > 0).select(F.col("nome_entita_cluster").alias("name")).distinct().orderBy("name")


def read_documents(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str] | str], pattern: str = "*.pdf") -> DataFrame:
    """Pages (source_file, page_number, text, error) of the binary files of a folder.

    ``extract`` turns a file's bytes into its page texts, or into one text of the
    whole document, which is page 1; it is where a PDF library comes in. A file it
    fails on has one row without page and text that says why, and stops no other.
    """

    def pages(path: str, content: bytes) -> list[tuple]:
        name = path.rsplit("/", 1)[-1]
        try:
            found = extract(bytes(content))
        except Exception as failed:  # noqa: BLE001 - libraries raise errors of their own
            return [(name, None, None, f"{type(failed).__name__}: {failed}")]
        return [(name, n, text, None) for n, text in enumerate([found] if isinstance(found, str) else found, 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in pages(path, content)]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "text", "error"]).astype(object)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInPandas(run, PAGES)


def read_structured(spark: SparkSession, folder: str, extract: Callable[[bytes], list[list[tuple[str, float, int]]]], pattern: str = "*.pdf") -> DataFrame:
    """Lines (source_file, page_number, ln, spans, error) for providers that know fonts.

    ``extract`` gives the lines of each page, a line as its spans (text, size,
    flags); see ``lines.style_average``. Files it fails on are as in ``read_documents``.
    """

    def lines(path: str, content: bytes) -> list[tuple]:
        name = path.rsplit("/", 1)[-1]
        try:
            found = extract(bytes(content))
        except Exception as failed:  # noqa: BLE001 - libraries raise errors of their own
            return [(name, None, None, None, f"{type(failed).__name__}: {failed}")]
        return [(name, n, k, [{"text": t, "size": float(z), "flags": int(f)} for t, z, f in line], None) for n, page in enumerate(found, 1) for k, line in enumerate(page)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in lines(path, content)]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "ln", "spans", "error"]).astype(object)

    schema = "source_file string, page_number int, ln int, spans array<struct<text: string, size: double, flags: int>>, error string"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInPandas(run, schema)


def read_entities(spark: SparkSession, path: str, clustered: bool = False) -> DataFrame:
    """Raw or clustered entities from JSON."""
    return read_json(spark, path, ENTITIES_CLUSTERED if clustered else ENTITIES_RAW)


def read_relations(spark: SparkSession, path: str, clustered: bool = False) -> DataFrame:
    """Raw or clustered relations from JSON."""
    return read_json(spark, path, RELATIONS_CLUSTERED if clustered else RELATIONS_RAW)


def outline(bookmarks: Column) -> Column:
    """Bookmarks (level, title, page) as outline entries."""
    return F.transform(bookmarks, lambda b: F.struct(b["level"].alias("level"), b["title"].alias("title"), b["page"].alias("page"), F.lit("bookmark").alias("type")))


def missing_embeddings(nodes: DataFrame) -> DataFrame:
    """Named nodes without an embedding."""
    return nodes.where("embedding IS NULL AND name IS NOT NULL")


def latest_file(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The path of the newest file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime")).first()[0]
