"""A Bloom filter of fixed size over a column of longs, built distributed and broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix

PROBES = 3
SEGMENT = 20
#: Filters of up to 2**GATHERED bits (16 MB) come to the driver in one job, larger ones a partition at a time.
GATHERED = 27


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, probe after probe."""
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([mix(h + np.uint64(i * 0x9E3779B9)) & mask for i in range(PROBES)]) if len(h) else h


def admits(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the filter may hold each hash."""
    p = positions(h, bits)
    if not len(p):
        return np.zeros(0, dtype=bool)
    return ((packed[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1).reshape(PROBES, -1).all(axis=0)


def by_segment(at: np.ndarray, bits: int) -> dict[int, bytes]:
    """Bit positions as packed offsets within segments."""
    at = np.sort(at)
    cut = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << SEGMENT, dtype=np.uint64))
    low = np.uint64((1 << SEGMENT) - 1)
    return {s: (at[cut[s] : cut[s + 1]] & low).astype(np.uint32).tobytes() for s in range(len(cut) - 1) if cut[s + 1] > cut[s]}


def build(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits of the filter of all values; 2**bits / 8 bytes whatever the input."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            parts = by_segment(positions(mix(h), bits), bits)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["seg", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(seg, np.zeros(1 << SEGMENT, dtype=bool))[np.frombuffer(at, dtype=np.uint32)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["seg", "bits"])

    n = min(1 << max(0, bits - SEGMENT), int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = ids.select(F.col(column).cast("long")).mapInArrow(collect, "seg int, at binary").repartition(n, "seg").mapInArrow(merge, "seg int, bits binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.collect() if bits <= GATHERED else parts.toLocalIterator():
        got = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out[row["seg"] * len(got) : (row["seg"] + 1) * len(got)] = got
    return out


def maybe_in(rows: DataFrame, column: str, ids: DataFrame, id_column: str, bits: int = 24) -> DataFrame:
    """Rows whose ``column`` may be among ``ids``: all that are, and a few others. Shrinks a join's large side."""
    held = rows.sparkSession.sparkContext.broadcast(build(ids, id_column, bits))

    @F.arrow_udf("boolean")
    def hit(x: pa.Array) -> pa.Array:
        return pa.array(admits(held.value, mix(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), bits))

    return rows.where(F.col(column).isNotNull()).where(hit(column))
