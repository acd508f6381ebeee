"""Shared-folder tables and vectorised text kernels used by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import own_folder

#: The six ASCII white-space bytes every word rule of this package splits on.
WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one set here when it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    own = own_folder(spark)
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strataloom/{uuid.uuid4().hex}/{name}.parquet"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets the context cleaner drop finished shuffles from the disks
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["table_path"] = path
    return out


def packed(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """(_row, columns): whole rows as one struct, so that no column of theirs can clash with those of a plan."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items()))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of ``packed`` again, with some columns changed."""
    return rows.select(*(changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns))


def sweep(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the table behind a ``written`` frame that nothing reads any more."""
    path = df.__dict__.get("table_path")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every step is a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 19)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def trim() -> None:
    """Give freed memory back to the machine: executors hold several workers at once."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """(first row, texts as bytes) runs of a batch with about ``most`` bytes each; null is empty."""
    if not batch.num_rows:
        return
    raw = batch.column(column).cast(pa.binary())
    total = np.cumsum(pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(total):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1
        yield at, [x or b"" for x in raw.slice(at, stop - at).to_pylist()]
        at = stop
    trim()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words before each text) of the texts joined by line ends.

    A word is a run of bytes outside WHITE, which is what ``[^\\x20\\x09-\\x0D]+``
    finds in the decoded text.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~_IS_WHITE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return data, starts, ends, np.searchsorted(starts, first)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one prefix sum over the bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbouring entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[i : i + n])
    return out
