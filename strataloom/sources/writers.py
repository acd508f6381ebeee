"""Writers: JSON, CSV, chunk tables, graph tables, embeddings; all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; ``read_json`` reads them and JSON arrays alike."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def chunk_table(chunks: DataFrame, default_page: int | None = 0) -> DataFrame:
    """Chunks as the lookup table keeps them: one row an id, the page defaulted."""
    rows = chunks.dropDuplicates(["chunk_id"]).where("chunk_id IS NOT NULL")
    page = F.col("page_number") if default_page is None else F.coalesce("page_number", F.lit(default_page))
    return rows.withColumn("page_number", page)


def write_chunk_table(chunks: DataFrame, path: str, default_page: int | None = 0) -> None:
    """Create the table unless it is there."""
    chunk_table(chunks, default_page).write.mode("ignore").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace a graph: its nodes, and its edges in a folder per predicate."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("predicate").parquet(f"{path}/edges")


def put_embeddings(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with the embeddings of (name, embedding) rows where there are such."""
    side = new.select(F.col("name").alias("_n"), F.col("embedding").alias("_e"))
    return nodes.join(side, nodes["name"] == side["_n"], "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_n", "_e")


def write_debug(chunks: DataFrame, path: str) -> None:
    """Each chunk's input text under a folder of its id."""
    chunks.select("chunk_id", F.concat(F.lit("CHUNK_ID: "), "chunk_id", F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("value")).write.mode("overwrite").partitionBy("chunk_id").text(path)
