"""Near-duplicate classes by MinHash with tensored banding, verified on full shingle sets.

Instead of one band of hashes per table, ``collections`` small collections of
``width`` hashes are computed, and every pair of collections forms the key of
one table: 12 collections of 2 hashes serve 66 tables of 4 hashes with 24 hash
functions rather than 264. A pair at similarity 0.8 misses every table with
probability 1e-4, a pair at 0.9 with 1e-8.

Short keys also bring texts together that share no more than boilerplate. So
whoever has a bucket mate is banded once more, with 36 collections of 6 hashes
(630 tables of 12 hashes): a pair at 0.8 misses all of these with probability
2.4e-4, and one at 0.3 meets in any with 3e-4.

Equal shingle sets are one class, so copies never meet each other. Inside a
table's bucket members are linked to one head only (a star), found first within
blocks, then across them, so a bucket sends one row per block. The stars of the
second banding connect bucket mates to families. Candidates are verified inside
families, in blocks of bounded size: every pair in different components is
compared on its full sets; no candidate is capped, and no pair is emitted but the
links found.

Words are runs of bytes outside ASCII white space, in lower case (A-Z). A text
with fewer words than a shingle has one shingle, the whole sequence; a text
without words (null, empty) has none and is linked with nothing. A null id links
nothing; its component is that of its copies, null without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import admits, build, maybe_in
from .components import components
from .shared import forget, mix, slices, trim, window_hashes, word_hashes, words, written

#: Bucket keys that a task holds at once.
KEYS = 1 << 20
#: (collections, width) of the second banding.
SECOND = (36, 6)
#: Size of the filter of ids that meet again, as a power of two (2 MB); a full one admits more ids and changes no result.
AMONG = 24
#: Parts that the rows of one family are dealt out to where they meet its size.
SALTS = 256
#: Documents of a family that are compared in one block, and shared shingles of a block that are compared at once.
MEMBERS, COLUMNS = 1024, 1 << 16
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    data, starts, ends, first = words([t.lower() for t in texts])
    h = word_hashes(data, starts, ends)
    w = window_hashes(h, size)
    out = []
    for i in range(len(texts)):
        n = first[i + 1] - first[i]
        own = w[first[i] : first[i + 1] - size + 1] if n >= size else window_hashes(h[first[i] : first[i + 1]], n) if n else w[:0]
        own = np.sort(own)
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def signatures(sets: list[np.ndarray], hashes: int, skip: int = 0) -> np.ndarray:
    """MinHash values by ``hashes`` functions after the first ``skip``, one row per non-empty set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    for i in range(hashes):
        out[:, i] = np.minimum.reduceat(flat * (_SEEDS[0, skip + i] * np.uint64(2) + np.uint64(1)) + _SEEDS[1, skip + i], at)
    return out


def table_keys(sig: np.ndarray, collections: int, width: int) -> np.ndarray:
    """The keys of all tables: a row per signature, a column per pair of collections."""
    parts = np.stack([window_hashes(sig[:, c * width : (c + 1) * width].T, width)[0] for c in range(collections)], axis=1)
    return np.stack([mix(parts[:, i] * np.uint64(0xA24BAED4963EE407) + parts[:, j] + np.uint64(t)) for t, (i, j) in enumerate(combinations(range(collections), 2))], axis=1)


def profiles(docs: DataFrame, size: int, hashes: int, skip: int = 0, among: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_shingles, fp, sig): set size, 128-bit fingerprint of the set, MinHash values.

    ``among``: the packed bits of a Bloom filter of AMONG bits; only ids that it admits are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                ids = batch.column("i")
                known = admits(held.value, mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), AMONG)
                batch = batch.filter(pa.array(known & ids.is_valid().to_numpy(zero_copy_only=False)))
            for at, texts in slices(batch, "t"):
                sets = shingle_sets(texts, size)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, hashes, skip)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("i").slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary")


def _keyed(batch: pa.RecordBatch, collections: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint64).reshape(-1, collections * width)
    keys = table_keys(sig, collections, width)
    ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), keys.shape[1])
    return keys.reshape(-1).view(np.int64), ids


def _popularity(sig: np.ndarray) -> np.ndarray:
    """How often each signature's values occur among all: highest for the text that its variants stem from."""
    out = np.zeros(len(sig), dtype=np.int64)
    for column in sig.T:
        _, inverse, times = np.unique(column, return_inverse=True, return_counts=True)
        out += times[inverse]
    return out


def star_candidates(classes: DataFrame, collections: int, width: int) -> DataFrame:
    """(a, b), a < b: every member of a bucket beside the bucket's head, or beside the head of its part of the bucket.

    The head is the member with the commonest signature, so that it resembles as
    many members as one can. Parts are blocks of KEYS bucket keys: what a task
    holds is bounded, and a bucket sends one row a block.
    """
    hashes = collections * width
    most = KEYS // (collections * (collections - 1) // 2)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = (np.concatenate(x) for x in zip(*(_keyed(b, collections, width) for b in held), strict=True))
        sig = np.frombuffer(b"".join(x for b in held for x in b.column("sig").to_pylist()), dtype=np.uint64).reshape(-1, hashes)
        weight = np.repeat(_popularity(sig), len(keys) // len(sig))
        order = np.lexsort((ids, -weight, keys))
        keys, ids, weight = keys[order], ids[order], weight[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        heads = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        pairs = np.unique(np.sort(np.stack([heads[~new], ids[~new]], axis=1), axis=1), axis=0)
        # pairs go on under a key of their own, a head under its bucket's
        key = np.concatenate((keys[new], mix(pairs[:, 1].view(np.uint64)).view(np.int64)))
        a, b = np.concatenate((ids[new], pairs[:, 0])), np.concatenate((ids[new], pairs[:, 1]))
        w = np.concatenate((-weight[new], np.zeros(len(pairs), dtype=np.int64)))
        for s in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in (key, w, a, b)], ["key", "w", "a", "b"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from block(held)
                    held, n = [], 0
        if n:
            yield from block(held)
        trim()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, 0
        for batch in batches:
            key, _, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            done = a != b
            own_a, own_b = [a[done]], [b[done]]
            key, ids = key[~done], a[~done]
            if len(key):
                new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
                at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
                heads = np.where(at >= 0, ids[np.maximum(at, 0)], head)
                own_a.append(heads[~new])
                own_b.append(ids[~new])
                last, head = key[-1], heads[-1]
            pairs = np.unique(np.sort(np.stack([np.concatenate(own_a), np.concatenate(own_b)], axis=1), axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    rows = classes.select("doc_id", "sig").mapInArrow(local, "key long, w long, a long, b long")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "w", "a").mapInArrow(across, "a long, b long").distinct()


def _linked(sets: list[np.ndarray], roots: np.ndarray, probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of set numbers that join all components that pairs of the similarity join; one of each such pair is a probe."""
    sizes = np.array([len(x) for x in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(times > 1)
    common = np.zeros((len(sets), len(sets)), dtype=np.int32)
    column = np.full(len(times), -1)
    for at in range(0, len(shared), COLUMNS):  # a bit matrix of sets and shared shingles, some columns at a time
        part = shared[at : at + COLUMNS]
        column[:] = -1
        column[part] = np.arange(len(part))
        here = column[inverse] >= 0
        dense = np.zeros((len(sets), -(-len(part) // 64) * 64), dtype=bool)
        dense[own[here], column[inverse[here]]] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        for i in np.flatnonzero(probe).tolist():
            common[i] += np.bitwise_count(bits & bits[i]).sum(axis=1, dtype=np.int32)
    root = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for i in np.flatnonzero(probe).tolist():
        near = np.flatnonzero(100 * common[i].astype(np.int64) >= percent * (sizes[i] + sizes - common[i]))
        for j in near.tolist():
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b:
                root[a] = b
                chosen += [i, j]
    # the members of what has come together hang on one of them: one step to walk, not a chain
    head: dict[int, int] = {}
    return [(head[r], i) for i in dict.fromkeys(chosen) if (r := find(int(roots[i]))) in head or head.setdefault(r, i) != i]


def block_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between components among the (family, block, id, root, probe) rows of each block, by full sets.

    A block holds a bounded number of members; a probe is held against all of
    them. Only links that join components come out.
    """
    texts = maybe_in(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), "i", members, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, np.ndarray]] = []  # rows that repeat an id stand beside each other
        key = None

        def links() -> Iterator[pa.RecordBatch]:
            ids, roots, probe = ([x[j] for x in held] for j in range(3))
            roots, probe = np.array(roots, dtype=np.int64), np.array(probe, dtype=bool)
            if len(ids) > 1 and roots.min() != roots.max() and probe.any():
                found = _linked([x[3] for x in held], roots, probe, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([min(ids[i], ids[j]) for i, j in found], pa.int64()), pa.array([max(ids[i], ids[j]) for i, j in found], pa.int64())], ["a", "b"])
            held.clear()

        for batch in batches:
            for at, raw in slices(batch, "t"):
                part = batch.slice(at, len(raw))
                rows = zip(*(part.column(c).to_pylist() for c in ("family", "block", "id", "root", "probe")), shingle_sets(raw, size), strict=True)
                for family, block, ident, root, probe, own in rows:
                    if (family, block) != key:
                        yield from links()
                        key = (family, block)
                    held.append((ident, root, probe, own))
        yield from links()
        trim()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = members.join(texts, members["id"] == texts["i"]).select("family", "block", "id", "root", "probe", "t")
    return met.repartition(n, "family", "block").sortWithinPartitions("family", "block").mapInArrow(run, "a long, b long")


def _salted(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def second_stars(docs: DataFrame, stars: DataFrame, size: int, skip: int) -> DataFrame:
    """(a, b): the stars of the second banding among all documents of ``stars``."""
    mates = written(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "mates")
    found = profiles(docs, size, SECOND[0] * SECOND[1], skip, build(mates, "id", AMONG)).where("n_shingles > 0").select("doc_id", "sig")
    # written, so that no task runs the workers of two steps at once
    strict = written(found.join(mates, found["doc_id"] == mates["id"], "left_semi"), "second_signatures")
    return star_candidates(strict, *SECOND)


def family_labels(docs: DataFrame, stars: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root): components of the links inside families, documents that buckets connect.

    Every pair of bucket mates lies in one family. Families are cut into blocks of
    MEMBERS documents, which are held against each other; then the members outside
    a family's largest component go to its other blocks as probes. So every pair
    in different components is compared on its full sets, and nothing but the
    links found is emitted.
    """
    families = _salted(components(stars).withColumnRenamed("root", "family"), "node")
    counted = families.groupBy("family", "salt").agg(F.count(F.lit(1)).alias("n"))  # a family has SALTS rows at most
    sizes = counted.select("family", "salt").join(counted.groupBy("family").agg(F.sum("n").alias("n")), "family")
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    rows = families.join(sizes, ["family", "salt"])
    rows = written(rows.select("family", F.col("node").alias("id"), blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "families")
    links = written(block_links(rows.select("family", "block", "id", F.col("id").alias("root"), F.lit(True).alias("probe")), docs, size, percent), "links")
    labels = components(links)
    large = rows.where("blocks > 1")
    if not large.take(1):
        return labels
    known = large.join(labels, large["id"] == labels["node"], "left").select("family", "block", "blocks", "id", F.coalesce("root", "id").alias("root"))
    most = known.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("root", "n").alias("most"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    dealt = most.select("family", "most", F.ceil(F.col("others") / MEMBERS).cast("int").alias("groups"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_ = written(_salted(known, "id").join(dealt, ["family", "salt"]).drop("salt"), "large_families")
    # a block meets the probes in groups that are as bounded as itself
    held = open_.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    probes = open_.where("root != most").withColumn("group", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("groups")).cast("int"))
    probes = probes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    place = lambda block: (F.col(block) * F.col("groups") + F.col("group")).alias("block")
    both = held.select("family", place("block"), "id", "root", F.lit(False).alias("probe")).union(probes.select("family", place("other"), "id", "root", F.lit(True)))
    more = written(block_links(both, docs, size, percent), "probe_links")
    return components(links.union(more)) if more.take(1) else labels


def classes_of(docs: DataFrame, size: int = 5, percent: int = 80, collections: int = 12, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    profile = written(profiles(docs, size, collections * width), "profiles")
    whole = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(whole.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    first = written(star_candidates(classes, collections, width), "bucket_mates")
    stars = written(second_stars(docs, first, size, collections * width), "stars")
    labels = family_labels(docs, stars, size, percent)
    for done in (first, stars):
        forget(done)
    held = classes.join(labels, classes["doc_id"] == labels["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "doc_id").alias("component_id"), "n", F.col("doc_id").alias("rep"))
    held = held.where("n > 1 OR component_id != rep").select("_fp", "component_id")
    out = profile.join(held, profile["fp"] == held["_fp"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
