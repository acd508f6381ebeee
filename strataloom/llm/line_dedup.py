"""Removal of lines that many documents share, by two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen
twice or more. Each partition sends bit positions, which merge segment by
segment; a bit set on both sides of a merge moves to the second filter, so that
filter has every line of two documents (and a few others). Only lines it admits
are shuffled, by their full text, to count documents exactly and to choose the
one document that keeps the line. A saturated filter admits more lines; it never
changes a result.

A line's key is the line without white space at its ends, in lower case (A-Z).
Suspected lines go along with their places in their text, so that a text is cut
by places and not by comparing lines again. Null and empty texts have one empty
line. Rows with a null id keep all lines and do not count as documents. Rows that
repeat an id count once and lose lines of the same keys. Ties cannot arise: the
largest id holding a key is one document. Bytes that are no UTF-8 count as U+FFFD
in keys. Extra columns are kept, but for those named as the columns added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import GATHERED, SEGMENT, admits, by_segment, positions
from .shared import WHITE, slices, written

#: Columns that ``drop_repeated_lines`` adds.
ADDED = ("_n_lines", "_n_dropped", "_text")
#: Least and largest filter: 2**30 bits are 128 MB, good for some 100 million lines.
LEAST_BITS, MOST_BITS = 20, 30
#: Parts that the lines with one key are dealt out to.
SALTS = 32


def _keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """The keys of at least ``least`` code points in a text, with the numbers of their lines."""
    found: dict[bytes, list[int]] = {}
    for n, line in enumerate(text.split(b"\n")):
        key = line.strip(WHITE)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            found.setdefault(key.lower(), []).append(n)
    return found


def filter_bits(docs: DataFrame) -> int:
    """The filter's size as a power of two, by the input's size as the planner knows it: about a bit for two bytes read."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // 2).bit_length()))


def repeat_filter(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The twice-seen filter as packed bits; its size is 2**bits / 8 bytes whatever the input."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for _, texts in slices(batch, "t"):
                seen.append(np.fromiter((xxhash.xxh3_64_intdigest(k) for t in texts for k in _keys(t, least)), dtype=np.uint64))
        if not seen:
            return
        once, n = np.unique(np.concatenate(seen), return_counts=True)
        parts = {}
        for kind, h in (("once", once), ("twice", once[n > 1])):
            for s, at in by_segment(positions(h, bits), bits).items():
                parts.setdefault(s, {})[kind] = at
        rows = sorted(parts)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([parts[s].get(k, b"") for s in rows], pa.binary()) for k in ("once", "twice"))], ["seg", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = held.setdefault(seg, (np.zeros(1 << SEGMENT, dtype=bool), np.zeros(1 << SEGMENT, dtype=bool)))
                at = np.frombuffer(once, dtype=np.uint32)
                b[at[a[at]]] = True
                a[at] = True
                b[np.frombuffer(twice, dtype=np.uint32)] = True
        rows = [s for s in held if held[s][1].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([np.packbits(held[s][1]).tobytes() for s in rows], pa.binary())], ["seg", "bits"])

    segments = 1 << max(0, bits - SEGMENT)
    spark = docs.sparkSession
    parts = docs.mapInArrow(collect, "seg int, once binary, twice binary").repartition(min(segments, int(spark.conf.get("spark.sql.shuffle.partitions"))), "seg")
    out = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
    bits_of = parts.mapInArrow(merge, "seg int, bits binary")
    for row in bits_of.collect() if bits <= GATHERED else bits_of.toLocalIterator():
        got = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out[row["seg"] * len(got) : (row["seg"] + 1) * len(got)] = got
    return out


def suspects(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(i, h, key, at) of lines the twice-seen filter admits, once per key and row of ``docs`` (i, h, t); ``at`` are their places."""
    held = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, least, bits))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = held.value
        for batch in batches:
            for at, texts in slices(batch, "t"):
                pairs = [(n, k, places) for n, t in enumerate(texts) for k, places in _keys(t, least).items()]
                hit = np.flatnonzero(admits(packed, np.fromiter((xxhash.xxh3_64_intdigest(k) for _, k, _ in pairs), dtype=np.uint64, count=len(pairs)), bits))
                if len(hit):
                    chosen = [pairs[j] for j in hit.tolist()]
                    row = pa.array([at + n for n, _, _ in chosen], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("i").take(row), batch.column("h").take(row), pa.array([k.decode("utf-8", "replace") for _, k, _ in chosen], pa.string()), pa.array([p for _, _, p in chosen], pa.list_(pa.int32()))], ["i", "h", "key", "at"]
                    )

    return docs.mapInArrow(admit, "i long, h long, key string, at array<int>")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bloom_bits: int | None = None) -> DataFrame:
    """The input with ``_n_lines``, ``_n_dropped`` and ``_text`` (lines left) added.

    ``bloom_bits``, at least 20, gives the filter's size as a power of two;
    otherwise it grows with the input up to MOST_BITS. Beyond that the filter fills
    up and more lines meet, with the same result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    # the suspected lines are counted, and then dealt out to the texts that lose them
    held = written(suspects(texts, min_chars, bloom_bits or filter_bits(texts)).dropDuplicates(["i", "h", "key"]), "suspects")
    common = held.select("key", "i").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("keeper")).where(F.col("n") >= min_docs)
    # a line that a large part of all documents share meets its keeper in SALTS parts
    keepers = common.select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = held.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
    lost = dealt.join(keepers, ["key", "part"]).where("i < keeper").groupBy("i", "h").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.col("text").alias("_t"))
    joined = rows.join(lost, (F.col("_i") == F.col("i")) & (F.xxhash64("_t") == F.col("h")), "left")
    lines = F.split(F.coalesce(F.col("_t"), F.lit("")), "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), F.col("at"), F.array(F.col("_n_lines").cast("int")))
    between = lambda k: F.slice(lines, F.element_at("_edges", k) + 2, F.element_at("_edges", k + 1) - F.element_at("_edges", k) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size("at") + 1), between)), "\n")
    out = joined.withColumn("_n_lines", F.size(lines).cast("long")).withColumn("_edges", F.when(F.col("at").isNotNull(), edges))
    text = F.when(F.col("at").isNotNull(), kept).otherwise(F.coalesce("_t", F.lit("")))
    made = F.struct("_n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("_n_dropped"), text.alias("_text"))
    return out.select("_row", made.alias("_made")).select(*(F.col("_row").getField(c).alias(c) for c in names), *(F.col("_made").getField(c).alias(c) for c in ADDED))


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"))
