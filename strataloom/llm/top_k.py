"""Exact top-k by inner product with a three-phase uniform threshold.

The components of the vectors are dealt to ``parts`` lists: list g holds the
components at positions g, g + parts, ... and so one part of every score.

1. Each list sends its best parts for each query. The exact scores of those few
   vectors give each query a cutoff t that its k-th best score reaches at least.
2. The cutoffs are broadcast, and each list sends every entry whose part is at
   least t / parts. A vector that no list sends has a score below t.
3. What was sent is brought together by vector; scores still incomplete are
   resolved exactly, those of at least t are kept and ranked.

Equal vectors are one class with its smallest k + 1 ids, so copies never blow up
the lists and ties go to the smaller id exactly. Queries run in blocks of
bounded size, so what is broadcast does not grow with the table.

Vectors that are null or hold null or non-finite components take no part; a
shorter vector counts as filled up with zeros. Rows that repeat an id count
once, with the smallest of their vectors; rows with a null id take no part. A
query with fewer than k other vectors gets all of them. Scores are exact while
they fit a long; beyond it they wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Components of the queries that are broadcast at once (32 MB as long).
BLOCK_CELLS = 1 << 22
_LEAST = -(1 << 62)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, in double arithmetic."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of long, filled up with zeros to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    for i, (at, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
        n = min(n, width)  # components beyond the queries' meet zeros
        out[i, :n] = flat[at : at + n]
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all queries with all rows; by doubles where those are exact."""
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if big < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _part(x: np.ndarray, g: int, parts: int) -> np.ndarray:
    return np.ascontiguousarray(x[:, g::parts])


def _dealt(v: Column, g: int, parts: int) -> Column:
    return F.filter(v, lambda _, i: i % parts == g)


def _steps(n_queries: int) -> int:
    """Vectors met at once: a few million products."""
    return max(16, (1 << 21) // max(1, n_queries))


def _local_best(held, k: int, parts: int):
    """Phase 1: (q, g, c, s), the k best parts of each query among the rows of a task, by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            group = batch.column("g").to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                mine = batch.filter(pa.array(group == g))
                q = _part(queries, g, parts)
                step = _steps(len(q))
                for at in range(0, mine.num_rows, step):
                    cut = mine.slice(at, step)
                    s = _products(q, _matrix(cut.column("x"), q.shape[1]))
                    c = np.broadcast_to(cut.column("c").to_numpy(zero_copy_only=False), s.shape)
                    if g in best:
                        s, c = np.concatenate((best[g][0], s), axis=1), np.concatenate((best[g][1], c), axis=1)
                    if s.shape[1] > k:
                        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        s, c = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
                    best[g] = (s, c)
        for g, (s, c) in best.items():
            n = s.shape[1]
            for at in range(0, len(s), 4096):
                part = slice(at, at + 4096)
                rows = len(s[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(at, at + rows, dtype=np.int32), n)), pa.array(np.full(rows * n, g, dtype=np.int32)), pa.array(c[part].reshape(-1)), pa.array(s[part].reshape(-1))], ["q", "g", "c", "s"]
                )

    return run


def _exact(held, parts: int, cutoffs):
    """Phase 3: (q, c, s, ids), exact scores of (c, ids, v, sent); ``sent`` has the parts each list sent.

    Complete scores are summed from the parts, incomplete ones are resolved from
    the vector, and only scores of at least the cutoff go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        least = cutoffs.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                vectors = _matrix(cut.column("v"), queries.shape[1])
                out_q, out_s, out_row = [], [], []
                for i, sent in enumerate(cut.column("sent").to_pylist()):
                    q = np.concatenate([np.frombuffer(x["q"], dtype=np.int32) for x in sent])
                    s = np.concatenate([np.frombuffer(x["s"], dtype=np.int64) for x in sent])
                    own, inverse, times = np.unique(q, return_inverse=True, return_counts=True)
                    score = np.zeros(len(own), dtype=np.int64)
                    np.add.at(score, inverse, s)
                    open_ = np.flatnonzero(times < parts)
                    if len(open_):
                        score[open_] = _products(queries[own[open_]], vectors[i : i + 1])[:, 0]
                    keep = score >= least[own]
                    own, score = own[keep], score[keep]
                    out_q.append(own.astype(np.int32))
                    out_s.append(score)
                    out_row.append(np.full(len(own), i))
                rows = pa.array(np.concatenate(out_row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), cut.column("c").take(rows), pa.array(np.concatenate(out_s)), cut.column("ids").take(rows)], ["q", "c", "s", "ids"])

    return run


def _send(held, cutoffs, parts: int):
    """Phase 2: (c, sent) with every part of at least cutoff / parts, a row per vector and list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = held.value, cutoffs.value
        need = -(-least // parts)  # parts are whole numbers
        for batch in batches:
            group = batch.column("g").to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                mine = batch.filter(pa.array(group == g))
                q = _part(queries, g, parts)
                step = _steps(len(q))
                for at in range(0, mine.num_rows, step):
                    cut = mine.slice(at, step)
                    s = _products(q, _matrix(cut.column("x"), q.shape[1]))
                    row, which = np.nonzero(s.T >= need)
                    if not len(row):
                        continue
                    edge = np.searchsorted(row, np.arange(cut.num_rows + 1))
                    full = np.flatnonzero(np.diff(edge))
                    which, values = which.astype(np.int32), s[which, row]
                    sent = [{"q": which[edge[i] : edge[i + 1]].tobytes(), "s": values[edge[i] : edge[i + 1]].tobytes()} for i in full.tolist()]
                    yield pa.RecordBatch.from_arrays([cut.column("c").take(pa.array(full)), pa.array(sent, pa.struct([("q", pa.binary()), ("s", pa.binary())]))], ["c", "sent"])

    return run


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(c, ids, v): distinct vectors with their smallest k ids; c is the smallest."""
    # only the first ranks of a vector leave a partition, however many rows share it
    ranked = vectors.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("c"), "ids", "v")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, parts: int = 2, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by ``every``, against all other rows."""
    spark = rows.sparkSession
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = written(good.groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(quantised(F.col("embedding"))).alias("v")), "vectors")
    classes = written(_classes(vectors, k + 1), "classes")
    lists = written(classes.select("c", F.posexplode(F.array(*(_dealt(F.col("v"), g, parts) for g in range(parts)))).alias("g", "x")), "lists")
    asked = vectors.where(F.col("id") % every == 0)
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    per_block = max(1, block_cells // max(1, width or 1))
    blocks = max(1, -(-n // per_block))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "asked") if blocks > 1 else asked.withColumn("block", F.lit(0))
    out = None
    for b in range(blocks):
        block = asked.where(F.col("block") == b).select("id", "v").toArrow()  # bounded by block_cells
        if not block.num_rows and blocks > 1:
            continue
        ids = block.column("id").to_numpy()
        lists_of = block.column("v").combine_chunks()
        held = spark.sparkContext.broadcast(_matrix(lists_of, width or 0))
        near = lists.mapInArrow(_local_best(held, k + 1, parts), "q int, g int, c long, s long")
        first = Window.partitionBy("q", "g").orderBy(F.col("s").desc(), "c")
        near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("q", "c").distinct()
        mine = near.groupBy("c").agg(F.collect_list("q").alias("qs")).join(classes, "c").select("c", "ids", "v", "qs")
        scored = mine.select("c", "ids", "v", "qs").mapInArrow(_scores(held), "q int, c long, s long")
        best = Window.partitionBy("q").orderBy(F.col("s").desc(), "c")
        found = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") == k + 1).select("q", "s").toArrow()
        least = np.full(len(ids), _LEAST, dtype=np.int64)
        least[found.column("q").to_numpy()] = found.column("s").to_numpy()
        cutoffs = spark.sparkContext.broadcast(least)
        sent = lists.mapInArrow(_send(held, cutoffs, parts), "c long, sent struct<q: binary, s: binary>").groupBy("c").agg(F.collect_list("sent").alias("sent"))
        kept = sent.join(classes, "c").select("c", "ids", "v", "sent").mapInArrow(_exact(held, parts, cutoffs), "q int, c long, s long, ids array<long>")
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids), dtype=np.int32), "query_id": ids}))
        hits = kept.join(names, "q").select("query_id", "s", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s").alias("score"))
        ranked = written(ranked, "ranked") if blocks > 1 else ranked
        out = ranked if out is None else out.union(ranked)
    return out


def _scores(held):
    """(q, c, s): exact scores of the queries listed beside each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), queries.shape[1])
            sizes = batch.column("qs").value_lengths().to_numpy(zero_copy_only=False)
            q = batch.column("qs").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            s = np.concatenate([(queries[q[at : at + 65536]] * vectors[row[at : at + 65536]]).sum(axis=1) for at in range(0, len(q), 65536)])
            yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("c").take(pa.array(row)), pa.array(s)], ["q", "c", "s"])

    return run
