"""SentencePiece encoding and decoding over a relational lattice.

Texts are split into units wherever two neighbouring characters stand side by
side in no piece of the model (so at every space), since no token can span such
a place. Every distinct unit is encoded once: its bounded-length substrings are
exploded, joined with the piece table, grouped into the unit's edges, and folded
with ``aggregate``. Documents are then assembled from the units' ids, common
units from a broadcast table of bounded size, the others through a join.

The fold. The vocabulary at hand is a BPE model, whose encoding is the result of
merging the best-ranked neighbouring pair again and again. A Viterbi path of
largest total score is another segmentation (ranks are no log-probabilities),
so for BPE models the fold carries the merge state over the same lattice: the
edges come by rank, the state is a bit per token bound, and an edge applies
where exactly two tokens make it up. A merge may enable an edge of better rank
that has passed already; the fold notices and gives the unit up (about one in
some hundred), and a heap merges it. For unigram models the fold carries the
Viterbi state. ``Vocabulary.kind`` chooses.

Characters without a piece become byte pieces. Null and empty texts have no
pieces. Units of more than ``LONG`` characters are merged with the heap (their
bounds don't fit a long); no text is cut.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import slices, sweep, trim, word_hashes, written

MARK = "▁"
#: Longest unit, in characters, that is folded in SQL.
LONG = 60
#: Rows of an Arrow batch while texts and units are read.
BATCH_ROWS = 200
#: Most units whose ids are broadcast, and most bytes of them; parts (a power of two) in which the driver gets them.
COMMON_UNITS, COMMON_BYTES, FOLDS = 3_000_000, 120 << 20, 8


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order with scores; ``kind`` is "bpe" or "unigram"."""

    kind: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: frozenset[int]
    bytes_at: tuple[int, ...]
    unknown: int

    @property
    def ranks(self) -> dict[str, int]:
        """The place of each piece's score among all scores, best first; equal scores share a rank."""
        place = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.normal}, reverse=True))}
        return {self.pieces[i]: place[self.scores[i]] for i in self.normal}

    @property
    def ids(self) -> dict[str, int]:
        return {self.pieces[i]: i for i in self.normal}

    @property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.normal)


def load(model_file: str) -> Vocabulary:
    """Read a model file whose pieces never hold a mark after another character."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = p.get_piece_size()
    pieces = tuple(p.id_to_piece(i) for i in range(n))
    normal = frozenset(i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)))
    bad = [pieces[i] for i in normal if MARK in pieces[i].lstrip(MARK)]
    if bad:
        raise ValueError(f"pieces span words: {bad[:3]}")
    return Vocabulary(_kind(p), pieces, tuple(p.get_score(i) for i in range(n)), normal, tuple(p.piece_to_id(f"<0x{b:02X}>") for b in range(256)), p.unk_id())


def _kind(p) -> str:
    """BPE models number their merges: their scores are whole numbers."""
    scores = [p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return "bpe" if all(float(s).is_integer() for s in scores) else "unigram"


@dataclass(frozen=True)
class Splitter:
    """Which neighbouring characters may belong to one token."""

    kind_of: np.ndarray  # by code point below 65536; 0: in no piece of several characters
    joins: np.ndarray

    def spans(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, unit starts, unit ends, units before each text): marks are spaces, every non-empty text starts with one."""
        mark = MARK.encode()
        full = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts]
        raw = b"".join(full)
        try:
            raw.decode()
        except UnicodeDecodeError:  # bytes that are no text read as U+FFFD
            full = [t.decode("utf-8", "replace").encode() for t in full]
            raw = b"".join(full)
        data = np.frombuffer(raw, dtype=np.uint8)
        edges = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in full], out=edges[1:])
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        point = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        kind = np.where(point < 65536, self.kind_of[point & 0xFFFF], 0)
        apart = np.ones(len(at), dtype=bool)
        apart[1:] = ~self.joins[kind[:-1], kind[1:]]
        apart[np.searchsorted(at, edges[:-1][np.diff(edges) > 0])] = True
        starts = at[apart]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return data, starts, ends, np.searchsorted(starts, edges)


def splitter(v: Vocabulary) -> Splitter:
    long = [v.pieces[i].replace(MARK, " ") for i in v.normal if len(v.pieces[i]) > 1]
    kinds = {c: k for k, c in enumerate(sorted({c for p in long for c in p if ord(c) < 65536}), 1)}
    kind_of = np.zeros(65536, dtype=np.int32)
    for c, k in kinds.items():
        kind_of[ord(c)] = k
    joins = np.zeros((len(kinds) + 1, len(kinds) + 1), dtype=bool)
    for p in long:
        for a, b in zip(p, p[1:], strict=False):
            joins[kinds.get(a, 0), kinds.get(b, 0)] = True
    return Splitter(kind_of, joins)


def unit_hashes(units: list[str]) -> np.ndarray:
    """The hash ``word_hashes`` gives the same units inside a text."""
    raw = [u.replace(MARK, " ").encode() for u in units]
    ends = np.cumsum([len(x) for x in raw])
    return word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, dtype=np.uint64)


def merge_ids(unit: str, ranks: dict[str, int], ids: dict[str, int], bytes_at: tuple[int, ...]) -> list[int]:
    """BPE ids of a unit by a heap over neighbouring pairs: the reference for the fold, and its stand-in for long units."""
    n = len(unit)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(unit[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out: list[int] = []
    i = 0
    while i < n:
        piece = unit[i : end[i]]
        out += [ids[piece]] if piece in ids else [bytes_at[b] for b in piece.encode()]
        i = end[i]
    return out


def risky_pieces(v: Vocabulary) -> set[str]:
    """Pieces whose making may enable a piece of better rank: one they begin or end, the rest being a token too."""
    ranks, ids, out = v.ranks, v.ids, set()
    for p, r in ranks.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if (len(a) == 1 or a in ids) and (len(b) == 1 or b in ids):
                out.update(x for x in (a, b) if len(x) > 1 and ranks[x] > r)
    return out


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(piece, rank, score, risky) of pieces of several characters: bounded by the vocabulary."""
    import pandas as pd  # here, so that workers don't load it

    at, ranks, risky = [i for i in sorted(v.normal) if len(v.pieces[i]) > 1], v.ranks, risky_pieces(v)
    rows = pd.DataFrame({"piece": [v.pieces[i] for i in at], "rank": [ranks[v.pieces[i]] for i in at], "score": [v.scores[i] for i in at], "risky": [v.pieces[i] in risky for i in at]})
    return spark.createDataFrame(rows, "piece string, rank int, score double, risky boolean")


def lattice(units: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(unit, freq, n, x): the edges of each unit by rank; none for a unit of one or of more than LONG characters.

    An edge from s to e has bits s and e in ``ends`` and the bits between in
    ``mid``. Units come partitioned by unit and stay so: substrings are exploded
    and met by the broadcast piece table in place, and grouped without a shuffle.
    The first character goes along whether it is a piece or not, so that no unit
    is lost.
    """
    short = f"n <= {LONG}"
    spans = units.withColumn("n", F.length("unit")).withColumn("s", F.expr(f"explode(sequence(0, IF({short}, greatest(n - 2, 0), 0)))"))
    spans = spans.withColumn("e", F.expr(f"explode(sequence(IF(s = 0, 1, s + 2), IF({short}, least(n, s + {longest}), 1)))"))
    edges = spans.select("unit", "freq", "n", "s", "e", F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    met = edges.join(F.broadcast(table), "piece", "left").where("rank IS NOT NULL OR e = 1")
    bit = lambda k: f"shiftleft(1L, {k})"
    edge = F.struct("rank", "s", "e", "score", "risky", F.expr(f"{bit('s')} | {bit('e')}").alias("ends"), F.expr(f"{bit('e')} - {bit('s + 1')}").alias("mid"))
    return met.groupBy("unit").agg(F.first("n").alias("n"), F.first("freq").alias("freq"), F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), edge))).alias("x"))


def _applies(mask: str, edge: str) -> str:
    """SQL: both ends are token bounds, and exactly one bound lies between."""
    inside = f"({mask} & {edge}.mid)"
    return f"({mask} & {edge}.ends) = {edge}.ends AND {inside} != 0 AND ({inside} & ({inside} - 1)) = 0"


def fold_bpe() -> Column:
    """The bit mask of a unit's token bounds, -1 where an edge was missed; edges come in the order of their ranks."""
    merged = "(m & ~e.mid)"
    missed = f"e.risky AND exists(x, y -> y.rank < e.rank AND {_applies(merged, 'y')})"
    return F.expr(f"aggregate(x, shiftleft(1L, n + 1) - 1, (m, e) -> IF(m > 0 AND {_applies('m', 'e')}, IF({missed}, -1L, {merged}), m))")


def fold_viterbi(v: Vocabulary) -> Column:
    """The bit mask of the token bounds of the path of largest total score; a single character scores as its piece or as unknown."""
    single = {p: v.scores[i] for p, i in v.ids.items() if len(p) == 1}
    known = F.create_map(*(F.lit(x) for pair in single.items() for x in pair)) if single else F.create_map().cast("map<string,double>")
    lone = lambda e: F.coalesce(F.try_element_at(known, F.substring(F.col("unit"), e, F.lit(1))), F.lit(min(v.scores) - 10.0))
    start = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(1).cast("long").alias("m")))

    def step(state: Column, e: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), e)
        options = F.transform(F.filter(F.col("x"), lambda x: x["e"] == e), lambda x: F.struct((F.element_at(state, x["s"] + 1)["v"] + x["score"]).alias("v"), F.element_at(state, x["s"] + 1)["m"].bitwiseOR(bit).alias("m")))
        plain = F.struct((F.element_at(state, e)["v"] + lone(e)).alias("v"), F.element_at(state, e)["m"].bitwiseOR(bit).alias("m"))
        return F.concat(state, F.array(F.array_max(F.concat(options, F.array(plain)))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step), -1)["m"]


def count_units(docs: DataFrame, split: Splitter, most: int = 250_000) -> DataFrame:
    """(unit, freq) over whole texts; equal units are counted before they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 16)], pa.string()), pa.array(counts[at : at + (1 << 16)])], ["unit", "n"])

        for batch in batches:
            for _, texts in slices(batch, "t"):
                data, starts, ends, _ = split.spans(texts)
                h, at, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
                place = _find(keys, h)
                np.add.at(counts, place[place >= 0], n[place >= 0])
                new = place < 0
                raw = data.tobytes()
                fresh = np.array([raw[s:e].decode().replace(" ", MARK) for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)], dtype=object)
                slot = np.searchsorted(keys, h[new])
                keys, counts, names = np.insert(keys, slot, h[new]), np.insert(counts, slot, n[new]), np.insert(names, slot, fresh)
                if len(keys) > most:
                    yield from rows()
                    keys, counts, names = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        yield from rows()
        keys = counts = names = fresh = None  # the worker stays for other tasks
        trim()

    return docs.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("freq"))


def unit_table(docs: DataFrame, v: Vocabulary, split: Splitter) -> DataFrame:
    """(h, freq, ids) of every distinct unit, as a written table.

    Units come from the fold as bit masks; the pieces between the bounds get their ids.
    """
    units = count_units(docs, split)
    net = lattice(units, piece_table(docs.sparkSession, v), v.longest)
    folded = net.select("unit", "freq", F.when(F.col("n") <= LONG, fold_bpe() if v.kind == "bpe" else fold_viterbi(v)).alias("mask"))
    ranks, ids = v.ranks, v.ids

    def pieces(unit: str, mask: int | None) -> list[int]:
        if mask is None or mask < 0:
            return merge_ids(unit, ranks, ids, v.bytes_at)
        bounds = [k for k in range(len(unit) + 1) if mask >> k & 1]
        out: list[int] = []
        for s, e in zip(bounds, bounds[1:], strict=False):
            piece = unit[s:e]
            out += [ids[piece]] if piece in ids else [v.bytes_at[b] for b in piece.encode()]
        return out

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("unit").to_pylist()
            lists = [pieces(u, m) for u, m in zip(own, batch.column("mask").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(unit_hashes(own).view(np.int64)), batch.column("freq"), pa.array(lists, pa.list_(pa.int32()))], ["h", "freq", "ids"])
        trim()

    return written(folded.mapInArrow(named, "h long, freq long, ids array<int>"), "units")


@dataclass(frozen=True)
class UnitIds:
    """Ids of units by sorted hash, with the first place of every run of leading hash bits."""

    least: int  # units seen less often are not here
    keys: np.ndarray  # and one more entry
    first: np.ndarray
    offsets: np.ndarray
    flat: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if absent."""
        out = np.full(len(h), -1)
        last = len(self.keys) - 1
        at = self.first[(h >> np.uint64(64 - (len(self.first).bit_length() - 1))).astype(np.int64)].astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[at]
            hit = (key == h) & (at < last)
            out[open_[hit]] = at[hit]
            go = (key < h) & (at < last)
            open_, at, h = open_[go], at[go] + 1, h[go]
        return out


def common_units(table: DataFrame, most: int, most_bytes: int = COMMON_BYTES) -> UnitIds:
    """The most frequent units, at most ``most`` of them and ``most_bytes`` in memory; all of them have ``least`` 0."""
    by_count = table.groupBy("freq").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).orderBy(F.col("freq").desc())
    n, total, least = 0, 0, 1 << 62
    for row in by_count.toLocalIterator():
        if n + row["n"] > most or 4 * (total + row["ids"]) + 14 * (n + row["n"]) > most_bytes:
            break
        n, total, least = n + row["n"], total + row["ids"], row["freq"]
    else:
        least = 0
    chosen = table.where(F.col("freq") >= least)
    keys, offsets = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.int32)  # a few million units have far fewer than 2**31 ids
    flat = np.empty(total, dtype=np.int32)
    at = begin = 0
    for fold in range(FOLDS):  # one run of leading hash bits after another: beside the arrays the driver holds one part of the rows
        got = chosen.where(F.shiftrightunsigned("h", 64 - FOLDS.bit_length() + 1) == fold).select("h", "ids").toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        lists = got.column("ids").combine_chunks().take(pa.array(order))
        end, stop = at + len(h), begin + len(lists.flatten())
        keys[at:end], flat[begin:stop] = h[order], lists.flatten().to_numpy(zero_copy_only=False)
        offsets[at + 1 : end + 1] = begin + np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        at, begin = end, stop
        del got, h, order, lists
        trim()
    bits = max(1, n.bit_length() - 2)
    first = np.searchsorted(keys[:n], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return UnitIds(least, keys, first, offsets, flat)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after another."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def encode(docs: DataFrame, v: Vocabulary, most: int = COMMON_UNITS, decoded: bool = False, digests: bool = False) -> DataFrame:
    """The input with ``ids`` (array<int>) in place of ``text``.

    With ``decoded``, the text of those ids goes along, as ``decode`` would give it
    in another pass; with ``digests`` the lower-case SHA-256 of that text as
    ``decoded_sha256``. Rarer units of a text meet the unit table in a join on the
    unit and come back to the text in a join on its hash, so neither ids nor repeated
    rows matter. Columns of the input named as those added are left out. The result
    is a written table: both passes run here, in batches of BATCH_ROWS rows.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_ROWS)  # texts, their ids and their rarer units stand side by side in a batch: keep it small
    try:
        return written(_encoded(docs, v, most, decoded, digests), "encoded")
    finally:
        conf.set(key, before)


def _encoded(docs: DataFrame, v: Vocabulary, most: int, decoded: bool, digests: bool) -> DataFrame:
    added = ["ids", *(["decoded"] if decoded else []), *(["decoded_sha256"] if digests else [])]
    texts = docs.select(F.xxhash64("text").alias("i"), F.col("text").alias("t"))
    split = splitter(v)
    table = unit_table(texts.select("t"), v, split)
    common = common_units(table, most)
    held, least = docs.sparkSession.sparkContext.broadcast(common), common.least
    pieces = docs.sparkSession.sparkContext.broadcast(_piece_bytes(v))
    del common
    trim()
    sweep(docs.sparkSession)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for at, part in slices(batch, "t"):
                data, starts, ends, first = split.spans(part)
                h = word_hashes(data, starts, ends)
                out = np.flatnonzero(known.find(h) < 0)
                if not len(out):
                    continue
                ids = np.repeat(batch.column("i").slice(at, len(part)).to_numpy(zero_copy_only=False), np.diff(first))
                one = np.unique(np.stack([ids[out], h[out].view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(one[:, 0].copy()), pa.array(one[:, 1].copy())], ["i", "h"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        offsets, flat = known.offsets, known.flat
        for batch in batches:
            for at, part in slices(batch, "_t"):
                data, starts, ends, first = split.spans(part)
                h = word_hashes(data, starts, ends)
                place = known.find(h)
                rows = batch.column("_rare").slice(at, len(part))
                own = rows.flatten()  # structs (h, ids) of all rows of the slice
                own_h = own.field("h").to_numpy(zero_copy_only=False).view(np.uint64) if len(own) else np.zeros(0, dtype=np.uint64)
                lists = own.field("ids")
                own_sizes = np.diff(lists.offsets.to_numpy()) if len(own) else np.zeros(0, dtype=np.int64)
                order = np.argsort(own_h)
                miss = place < 0
                mine = _find(own_h[order], h[miss])
                sizes, begin = np.empty(len(h), dtype=np.int64), np.empty(len(h), dtype=np.int64)
                sizes[~miss], begin[~miss] = offsets[place[~miss] + 1] - offsets[place[~miss]], offsets[place[~miss]]
                if miss.any():
                    sizes[miss], begin[miss] = own_sizes[order][mine], lists.offsets.to_numpy()[:-1][order][mine] + len(flat)
                    pool = np.concatenate((flat, lists.values.to_numpy(zero_copy_only=False).astype(np.int32)))
                else:
                    pool = flat
                total = np.zeros(len(h) + 1, dtype=np.int64)
                np.cumsum(sizes, out=total[1:])
                found = pool[_ranges(begin, sizes)]
                columns = [batch.column("_row").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(total[first].astype(np.int32)), pa.array(found, pa.int32()))]
                back = _texts(found, total[first], *pieces.value) if decoded or digests else []
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                if digests:
                    columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["_row", *added])

    rest = [c for c in docs.columns if c not in ("text", *added)]
    packed = docs.select(F.xxhash64("text").alias("_i"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col("text").alias("_t"))
    empty = F.array().cast("array<struct<h:bigint,ids:array<int>>>")
    if least:
        pairs = texts.mapInArrow(rare, "i long, h long")
        met = pairs.join(table.where(F.col("freq") < least).select("h", "ids"), "h")
        per_doc = met.groupBy("i").agg(F.collect_set(F.struct("h", "ids")).alias("_rare"))
        joined = packed.join(per_doc, packed["_i"] == per_doc["i"], "left").select("_row", "_t", F.coalesce("_rare", empty).alias("_rare"))
    else:  # every unit is broadcast
        joined = packed.select("_row", "_t", empty.alias("_rare"))
    schema = StructType([packed.schema["_row"], StructField("ids", ArrayType(IntegerType())), *(StructField(c, StringType()) for c in added[1:])])
    return joined.mapInArrow(assemble, schema).select(*(F.col("_row").getField(c).alias(c) for c in rest), *added)


def _piece_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of what every id decodes to; control ids decode to nothing."""
    raw = [b""] * len(v.pieces)
    for i in v.normal:
        raw[i] = v.pieces[i].replace(MARK, " ").encode()
    for b, i in enumerate(v.bytes_at):
        raw[i] = bytes([b])
    return np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), dtype=np.uint8)


def _texts(ids: np.ndarray, edges: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[str]:
    """The texts of ids between neighbouring edges, without the mark that begins each."""
    begin = np.cumsum(sizes) - sizes
    data = flat[_ranges(begin[ids], sizes[ids])].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes[ids])))[edges].tolist()
    return [data[s + 1 : e].decode("utf-8", "replace") for s, e in zip(at, at[1:], strict=False)]


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """The input with ``decoded`` added: the text of ``ids``, which is the encoded text with word marks as spaces."""
    held = rows.sparkSession.sparkContext.broadcast(_piece_bytes(v))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column("ids")
                edges = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                texts = _texts(lists.flatten().to_numpy(zero_copy_only=False), edges, *held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) of every row."""
    out = encode(docs.select("doc_id", "text"), load(model_file), digests=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256")
