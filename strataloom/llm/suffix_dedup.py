"""Removal of byte strings that earlier documents hold, by bucket-pointer refinement.

A suffix's initial bucket is its q-gram (q is a quarter of the length sought),
named by a hash. Buckets are refined by the bucket identifiers of later offsets,
and refined identifiers are used again in the next refinement: the identifiers at
i and q - 1 bytes on name the half-length bucket of i, and those of the half-length
buckets at i and half a length on name the full 50-byte bucket. Two independent
families of hashes are refined side by side; nothing but sorting on refined
identifiers decides what repeats.

Only some suffixes are dealt out: of the half-length buckets of every 50-byte
window, the one with the least identifier (the window's anchor) stands for the window. Equal windows
have equal anchors, so no repeat is lost. An anchor owns the neighbouring windows
it stands for, [a, b].

1. Anchors meet by half-length bucket, refined by the full buckets of a and b. If
   a smaller document has the same refined bucket, all owned windows repeat.
   Before anything leaves a task, each refined bucket is reduced to its smallest
   document there; larger ones are settled, so a bucket that a third of all
   documents share costs one entry a task.
2. Where one half-length bucket split into several refined buckets, the first
   document of each may still share single windows with the others. Their owned
   windows are sorted one by one on their full buckets and settled in the same way.
3. What is settled goes back to its document as byte spans and is cut out.

What decides is 104 bits of two independent hashes; bytes are not compared again.
Texts are UTF-8 bytes (null: empty); texts under 50 bytes hold no string sought.
Rows with a null id neither lose nor take anything. Rows that repeat an id are no
smaller than each other, whether their texts agree or not, and every row gives one
row. Extra columns are kept, but for those named as the columns added. Texts of any
length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .shared import _BYTE_CODE, mix, powers, slices, sweep, written

LENGTH = 50
#: Bytes of text whose entries are sorted and reduced together before they leave a task.
HELD = 24 << 20
#: Rows that a task unpacks and sorts at once.
MET = 3_000_000
_K1, _K2, _K3 = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))
_H_MASK = np.uint64((1 << 48) - 1)
_C_MASK = np.uint64((1 << 56) - 1)
_SECOND_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Columns that ``cut_repeats`` adds.
ADDED = ("_kept", "_n_bytes", "_spans")


class Buckets:
    """Bucket identifiers of a text's offsets for one family of hashes, refined by those of later offsets."""

    def __init__(self, data: np.ndarray, code: np.ndarray, length: int):
        self.length, self.half = length, (length + 1) // 2
        self.q = (self.half + 1) // 2
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(code[data] * up[: len(data)], out=self.total[1:])

    def _grams(self, at: np.ndarray | slice, to: np.ndarray | slice) -> np.ndarray:
        return mix((self.total[to] - self.total[at]) * self.down[at])

    def halves(self) -> np.ndarray:
        """The half-length bucket at every offset."""
        n = len(self.total) - 1 - self.q + 1
        g = self._grams(slice(0, n), slice(self.q, self.q + n))
        step = self.half - self.q
        return mix(g[: n - step] * _K1 + g[step:] * _K2)

    def half_at(self, at: np.ndarray) -> np.ndarray:
        """The half-length bucket at some offsets."""
        later = at + (self.half - self.q)
        return mix(self._grams(at, at + self.q) * _K1 + self._grams(later, later + self.q) * _K2)

    def full(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The full bucket of offsets from the half-length buckets there and at ``length - half`` bytes on."""
        return mix(one * _K3 + two * _K1)

    def full_at(self, at: np.ndarray) -> np.ndarray:
        return self.full(self.half_at(at), self.half_at(at + self.length - self.half))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least entry of each run of ``w``."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def _windows(edges: np.ndarray, length: int, n: int) -> np.ndarray:
    """Starts of all windows inside texts; a text is edges[i] to edges[i + 1] - 1 (a separator ends it)."""
    last = edges[1:] - 1 - length
    good = last >= edges[:-1]
    flag = np.zeros(n + 2, dtype=np.int32)
    np.add.at(flag, edges[:-1][good], 1)
    np.add.at(flag, last[good] + 1, -1)
    return np.flatnonzero(np.cumsum(flag[:n]))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    edges = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), edges


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first owned window, further owned windows, half-length bucket, refined bucket) of every anchor."""
    data, edges = _joined(texts)
    starts = _windows(edges, length, len(data))
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    first, second = Buckets(data, _BYTE_CODE, length), Buckets(data, _SECOND_CODE, length)
    g = first.halves()
    bits = np.uint64(len(data).bit_length())
    least = _window_min((g >> bits << bits) | np.arange(len(g), dtype=np.uint64), length - first.half + 1)
    p = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1))))
    a, b, p = starts[new], starts[np.append(new[1:], len(starts)) - 1], p[new]
    # a and b are at most half a length apart, so their full buckets name all bytes from a to b + length
    c = mix(second.full_at(a) * _K1 + second.full_at(b) * _K2 + ((p - a) * 64 + (b - a)).astype(np.uint64))
    text = np.searchsorted(edges, a, side="right") - 1
    return text, a - edges[text], b - a, g[p], c


def windows_at(texts: list[bytes], text: np.ndarray, first: np.ndarray, more: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, window start, full buckets of both families) of all windows from ``first`` to ``first + more``."""
    data, edges = _joined(texts)
    size = more + 1
    own = np.repeat(np.arange(len(text)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]
    whole = at + edges[text[own]]
    one, two = (Buckets(data, code, length).full_at(whole) for code in (_BYTE_CODE, _SECOND_CODE))
    return text[own], at, one, two


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as its least value and byte planes of what is above it."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for x in columns:
        x = np.ascontiguousarray(x)
        low = x.min()
        rest = x.view(np.uint64) - np.array([low]).view(np.uint64)
        planes = (int(rest.max()).bit_length() + 7) // 8
        raw = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes]
        out += [np.array([low]).tobytes(), bytes([planes]), np.ascontiguousarray(raw.T).tobytes()]
    return b"".join(out)


def unpack_columns(body: bytes, kinds: str) -> list[np.ndarray]:
    """The columns again: i for long, u for unsigned."""
    n, at, out = int.from_bytes(body[:4], "little"), 4, []
    for kind in kinds:
        low, planes = np.frombuffer(body, "<u8", 1, at), body[at + 8]
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :planes] = np.frombuffer(body, np.uint8, n * planes, at + 9).reshape(planes, n).T
        at += 9 + n * planes
        x = raw.reshape(-1).view("<u8") + low
        out.append(x.view(np.int64) if kind == "i" else x)
    return out


ENTRY, SPAN = "uuiiii", "iiiii"  # h, c, doc, nth, at, more; doc, nth, start, end, open


def _merged(doc: np.ndarray, nth: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans in order, with overlapping and touching ones of a document made one."""
    order = np.lexsort((start, nth, doc))
    doc, nth, start, end = doc[order], nth[order], start[order], end[order]
    row = np.cumsum(np.concatenate(([0], ((doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1])).astype(np.int64)))) if len(doc) else doc
    high = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40) if len(doc) else end
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > high[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
    stop = np.append(new[1:], len(doc)) - 1 if len(new) else new
    return doc[new], nth[new], start[new], high[stop]


def _reduced(h, c, doc, nth, at, more, length: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Order by (h, c, doc), and who of it is settled: a smaller document has the same refined bucket."""
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    return order, (h, c, doc, nth[order], at[order], more[order], doc > first)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(16) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "body"])


_ROWS = "part int, kind int, body binary"


def _by_part(part: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """One row of packed columns for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [x[order] for x in columns]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
    rows = [(int(part[i]), kind, pack_columns(*(x[i:j] for x in columns))) for i, j in zip(cut, [*cut[1:], len(part)], strict=True)]
    for at in range(0, len(rows), 256):
        yield _rows(rows[at : at + 256])


class _Entries:
    """Entries of a task, reduced to the smallest document of each refined bucket when flushed."""

    def __init__(self, parts: int, length: int):
        self.parts, self.length, self.held, self.size = parts, length, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(columns)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.size = [], 0
            _, (h, c, doc, nth, at, more, settled) = _reduced(*columns, self.length)
            yield from _spans(doc[settled], nth[settled], at[settled], (at + more + self.length)[settled], False, self.parts)
            left = ~settled
            yield from _by_part(_part_of(h[left], self.parts), [x[left] for x in (h, c, doc, nth, at, more)], 0)


def _spans(doc, nth, start, end, open_: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of spans by the part of their document; open ones keep their bounds, others are merged."""
    if not open_:
        doc, nth, start, end = _merged(doc, nth, start, end)
    part = _part_of(mix(doc.astype(np.uint64)), parts)
    yield from _by_part(part, [doc, nth, start, end, np.full(len(doc), int(open_), dtype=np.int64)], 1)


def _anchor_entries(parts: int, length: int):
    """Entries of all anchors of (i, k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Entries(parts, length)
        for batch in batches:
            for at, texts in slices(batch, "t"):
                ids, nth = (batch.column(c).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "k"))
                text, first, more, h, c = anchors(texts, length)
                held.add(h & _H_MASK, c & _C_MASK, ids[text], nth[text], first, more)
                held.size += sum(map(len, texts))
                if held.size >= HELD:
                    yield from held.flush()
        yield from held.flush()

    return run


def _window_entries(parts: int, length: int):
    """Entries of the open windows of (i, k, t, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Entries(parts, length)
        for batch in batches:
            for at, texts in slices(batch, "t"):
                ids, nth = (batch.column(c).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "k"))
                spans = [unpack_columns(x, "ii") for x in batch.column("open").slice(at, len(texts)).to_pylist()]
                text = np.repeat(np.arange(len(texts)), [len(x[0]) for x in spans])
                first, last = (np.concatenate([x[j] for x in spans]) for j in (0, 1))
                text, start, one, two = windows_at(texts, text, first, last - first - length, length)
                held.add(one & _H_MASK, (two & _C_MASK), ids[text], nth[text], start, np.zeros(len(start), dtype=np.int64))
                held.size += 16 * len(start)
                if held.size >= HELD:
                    yield from held.flush()
        yield from held.flush()

    return run


def _folds(bodies: list[bytes], kinds: str, of) -> Iterator[list[np.ndarray]]:
    """The columns of many bodies, at most about MET rows at a time; rows that ``of`` maps to one number stay together.

    Every body is unpacked once: more than one fold are dealt out as packed columns first.
    """
    total = sum(int.from_bytes(b[:4], "little") for b in bodies)
    folds = -(-total // MET)
    if folds <= 1:
        if bodies:
            yield [np.concatenate(x) for x in zip(*(unpack_columns(b, kinds) for b in bodies), strict=True)]
        return
    dealt: list[list[bytes]] = [[] for _ in range(folds)]
    while bodies:
        columns = unpack_columns(bodies.pop(), kinds)
        fold = (of(columns) % np.uint64(folds)).astype(np.int64)
        order = np.argsort(fold, kind="stable")
        edge = np.searchsorted(fold[order], np.arange(folds + 1))
        for f in np.flatnonzero(np.diff(edge)).tolist():
            dealt[f].append(pack_columns(*(x[order[edge[f] : edge[f + 1]]] for x in columns)))
    for f in range(folds):
        if dealt[f]:
            yield [np.concatenate(x) for x in zip(*(unpack_columns(b, kinds) for b in dealt[f]), strict=True)]
        dealt[f] = []


def _settle(parts: int, length: int, refine: bool):
    """Entries meet by bucket; spans of earlier steps pass. Open spans come out if ``refine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, spans = [], []
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                (spans if kind else bodies).append(body)
        shut, opened = list(spans), []
        for columns in _folds(bodies, ENTRY, lambda x: mix(x[0])):
            if not len(columns[0]):
                continue
            _, (h, _, doc, nth, at, more, settled) = _reduced(*columns, length)
            if settled.any():
                d, n, s, e = _merged(doc[settled], nth[settled], at[settled], (at + more + length)[settled])
                shut.append(pack_columns(d, n, s, e, np.zeros(len(d), dtype=np.int64)))
            if refine:
                left = np.flatnonzero(~settled)  # the first documents of all refined buckets
                bucket = np.cumsum(np.concatenate(([0], (h[left][1:] != h[left][:-1]).astype(np.int64))))
                low, high = np.full(bucket[-1] + 1, np.iinfo(np.int64).max), np.full(bucket[-1] + 1, np.iinfo(np.int64).min)
                np.minimum.at(low, bucket, doc[left])
                np.maximum.at(high, bucket, doc[left])
                open_ = left[(low < high)[bucket]]
                if len(open_):
                    opened.append(pack_columns(doc[open_], nth[open_], at[open_], (at + more + length)[open_], np.ones(len(open_), dtype=np.int64)))
        for columns in _folds(shut, SPAN, lambda x: mix(x[0].astype(np.uint64))):
            yield from _spans(*columns[:4], False, parts)
        for columns in _folds(opened, SPAN, lambda x: mix(x[0].astype(np.uint64))):
            yield from _spans(*columns[:4], True, parts)

    return run


def _by_document():
    """(i, k, spans, open) of each document."""

    def one(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, nth, start, end, open_ = columns
        shut = open_ == 0
        found: dict[tuple[int, int], list[bytes | None]] = {}
        for j, (d, n, s, e) in enumerate((_merged(doc[shut], nth[shut], start[shut], end[shut]), tuple(x[~shut] for x in (doc, nth, start, end)))):
            order = np.lexsort((s, n, d))
            d, n, s, e = d[order], n[order], s[order], e[order]
            cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (n[1:] != n[:-1])))).tolist() if len(d) else []
            for x, y in zip(cut, [*cut[1:], len(d)], strict=False):
                found.setdefault((int(d[x]), int(n[x])), [None, None])[j] = pack_columns(s[x:y], e[x:y])
        keys = list(found)
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int32()), *(pa.array([found[x][j] for x in some], pa.binary()) for j in (0, 1))], ["i", "k", "spans", "open"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [x for batch in batches for x in batch.column("body").to_pylist()]
        for columns in _folds(bodies, SPAN, lambda x: mix(x[0].astype(np.uint64))):
            if len(columns[0]):
                yield from one(columns)

    return run


def _resolved(entries: DataFrame, parts: int, length: int, refine: bool, name: str) -> DataFrame:
    """Entries to (i, k, spans, open) rows of documents, through two exchanges of packed columns."""
    met = entries.repartitionById(parts, "part").mapInArrow(_settle(parts, length, refine), _ROWS)
    back = met.repartitionById(parts, "part")
    return written(back.mapInArrow(_by_document(), "i long, k int, spans binary, open binary"), name)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(i, k, t) of all rows with an id, and (i, h, k) of the ids that have different texts, if there are any.

    ``k`` tells the different texts of a repeated id apart and is 0 for all other
    rows; ``h`` is the text's hash. Rows of an id with one text may repeat.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    hashed = rows.groupBy("i").agg(F.min(F.xxhash64("t")).alias("a"), F.max(F.xxhash64("t")).alias("b"))
    several = written(hashed.where("a != b").select("i"), "several")
    if not several.take(1):
        return rows.select("i", F.lit(0).alias("k"), "t"), None
    own = rows.join(several, "i").withColumn("h", F.xxhash64("t")).dropDuplicates(["i", "h"])
    own = written(own.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("h")) - 1), "numbered")
    return rows.join(several, "i", "left_anti").select("i", F.lit(0).alias("k"), "t").union(own.select("i", "k", "t")), own.select("i", "h", "k")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(i, k, spans): byte spans of (i, k, t) that hold a string of a smaller document, as packed (start, end)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where(F.octet_length("t") >= length)
    found = _resolved(long.mapInArrow(_anchor_entries(parts, length), _ROWS), parts, length, True, "anchors")
    sweep(spark)
    open_ = found.where("open IS NOT NULL").select("i", "k", "open")
    texts = long.join(open_.hint("shuffle_hash"), ["i", "k"]).select("i", "k", "t", "open")
    more = _resolved(texts.mapInArrow(_window_entries(parts, length), _ROWS), parts, length, False, "windows")
    sweep(spark)
    return found.where("spans IS NOT NULL").select("i", "k", "spans").union(more.where("spans IS NOT NULL").select("i", "k", "spans"))


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The input with ``_kept`` (binary), ``_n_bytes`` and ``_spans`` (array of start, end) added."""
    rows, several = _numbered(docs)
    spans = repeated_spans(rows, length)
    names = [c for c in docs.columns if c not in ADDED]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.col("text").alias("t"))
    if several is None:
        packed = whole.withColumn("_k", F.lit(0))
    else:
        known = several.select(F.col("i").alias("_si"), F.col("h").alias("_sh"), F.col("k").alias("_sk"))
        packed = whole.join(known, (F.col("_i") == F.col("_si")) & (F.xxhash64("t") == F.col("_sh")), "left").withColumn("_k", F.coalesce("_sk", F.lit(0)))
    held = spans.groupBy("i", "k").agg(F.collect_list("spans").alias("_held"))
    joined = packed.join(held.hint("shuffle_hash"), (F.col("_i") == F.col("i")) & (F.col("_k") == F.col("k")), "left").select("_row", "t", "_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "t", 4 << 20):
                kept, spans = [], []
                for t, bodies in zip(texts, batch.column("_held").slice(at, len(texts)).to_pylist(), strict=True):
                    if not bodies:
                        kept.append(t)
                        spans.append([])
                        continue
                    start, end = (np.concatenate(x) for x in zip(*(unpack_columns(b, "ii") for b in bodies), strict=True))
                    zero = np.zeros(len(start), dtype=np.int64)
                    _, _, start, end = _merged(zero, zero, start, end)
                    pairs = list(zip(start.tolist(), end.tolist(), strict=True))
                    ends = [0, *(e for _, e in pairs)]
                    kept.append(b"".join(t[i:j] for i, j in zip(ends, [*(s for s, _ in pairs), len(t)], strict=True)))
                    spans.append([{"start": s, "end": e} for s, e in pairs])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(at, len(texts)), pa.array(kept, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["_row", *ADDED],
                )

    pair = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([packed.schema["_row"], StructField("_kept", BinaryType()), StructField("_n_bytes", LongType()), StructField("_spans", ArrayType(pair))])
    return joined.mapInArrow(run, schema).select(*(F.col("_row").getField(c).alias(c) for c in names), *ADDED)


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """The removed spans of each document, by a table of all strings."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        t, spans = texts[doc], []
        own = [t[i : i + length] for i in range(len(t) - length + 1)]
        for i, s in enumerate(own):
            if s in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        seen.update(own)
        out[doc] = spans
    return out


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut_repeats(docs.select("doc_id", "text")).select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
