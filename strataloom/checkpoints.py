"""Cutting the lineage of iterative plans through a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """A folder of this machine, where no shared one is set: only for masters that run on this machine alone."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="strataloom-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table under ``spark.checkpoint.dir``, written and read back; a folder of its own only where that is unset (tests).

    Its columns are compressed, read only where asked for, and of a known size, so
    that a small table is broadcast to a large one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))
    path = f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/cut-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
