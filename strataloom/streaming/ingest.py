"""Incremental runs: stages that reuse what exists, exclusion of what is done, and a stream of new chunks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stage(spark: SparkSession, path: str, compute: Callable[[], DataFrame], redo: bool = False) -> DataFrame:
    """The table at ``path``, computed and written first if it is missing."""
    if not redo:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remaining(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Non-blank chunks whose id is not among those done; by id, so that changed inputs resume rightly."""
    return chunks.where(F.length(F.trim("text")) > 0).join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def save_batches(rows: DataFrame, path: str, key: str, batches: int) -> int:
    """Append ``rows`` to the table at ``path`` in ``batches`` runs by a hash of ``key``; what a run has saved a new start skips.

    Returns the number of runs that had anything left to save.
    """
    spark, saved = rows.sparkSession, 0
    for b in range(batches):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        try:
            part = part.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        except AnalysisException:  # nothing saved yet
            pass
        if part.take(1):
            part.select(*rows.columns).write.mode("append").parquet(path)
            saved += 1
    return saved


def discard(spark: SparkSession, path: str) -> bool:
    """Delete a finished run's table or folder; whether there was one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def measured(rows: DataFrame, name: str = "throughput") -> tuple[DataFrame, Callable[[], dict[str, float]]]:
    """``rows``, and a function that gives their number, seconds and rows a second once an action has run over them."""
    seen, began = Observation(name), time.time()

    def figures() -> dict[str, float]:
        n = seen.get["n"]
        seconds = max(time.time() - began, 1e-9)
        return {"n": n, "seconds": seconds, "rows_per_second": n / seconds}

    return rows.observe(seen, F.count(F.lit(1)).alias("n")), figures


def ingest(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Process each new file of chunks once and append the results; the stream's checkpoint is the resume point.

    A batch that runs again after a failure overwrites its own folder, so nothing
    is appended twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
