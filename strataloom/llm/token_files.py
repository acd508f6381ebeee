"""Token ids in Simple-8b coded pages with per-block offsets.

Page layout (little-endian): ``MAGIC``, u32 documents, u32 ids, u32 words,
u32 escapes, u32 blocks; i64 document ids; u32 ids before each document and in
all; u32 word offset of each block; u64 words; u32 escaped ids.

A word holds a 4-bit selector in its top bits and as many ids as fit its 60
low bits at the selector's width. Ids wider than the widest packed width are
escapes: selector 15 says that the word's low bits count ids held in the escape
list. A block is ``BLOCK`` ids; packing restarts at every block, so a reader can
decode any block on its own, and all words of one selector at once.

Pages are rows of a table that Spark writes, so the files live wherever Spark
can write. Documents are in ascending id order over all pages.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import slices, word_hashes

MAGIC = b"S8B1"
BLOCK = 4096
#: (ids in a word, bits of an id) by selector; selector 15 marks escapes.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_HEAD = np.uint64(0x9FB21C651E98DF25)
#: Stands for ids that a chunk does not have by itself; no number of ids has this length.
_WHOLE = b"?"
_WIDEST = 30
_COUNTS = np.array([c for c, _ in SELECTORS] + [0] * (16 - len(SELECTORS)), dtype=np.int64)


_WIDTHS = np.array(sorted({w for _, w in SELECTORS if w <= _WIDEST}), dtype=np.uint8)
_LIMITS = np.left_shift(np.uint64(1), _WIDTHS.astype(np.uint64))
#: The least packed width of every id of two bytes.
_SMALL = _WIDTHS[np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right")]


def _level(ids: np.ndarray) -> np.ndarray:
    """The least packed width of each id (99 for an escape)."""
    out = _SMALL[ids & np.uint32(0xFFFF)]
    wide = np.flatnonzero(ids >> np.uint32(16))
    if len(wide):
        out[wide] = np.append(_WIDTHS, np.uint8(99))[np.searchsorted(_LIMITS, ids[wide].astype(np.uint64), side="right")]
    return out


def _fits(level: np.ndarray) -> np.ndarray:
    """For every position of blocks (rows; 255 past their ends) the densest selector whose full word fits the ids that follow.

    Escapes have -1. The last words of a block may hold few ids.
    """

    def ahead(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate((x[:, n:], np.full((len(x), n), 255, dtype=np.uint8)), axis=1)

    power = {1: level}
    best = np.where(level <= _WIDEST, len(SELECTORS) - 1, -1).astype(np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):  # from few wide ids to many narrow ones
        count, width = SELECTORS[s]
        top = 1 << (count.bit_length() - 1)
        while max(power) < top:
            k = max(power)
            power[2 * k] = np.maximum(power[k], ahead(power[k], k))
        most = power[top] if top == count else np.maximum(power[top], ahead(power[top], count - top))
        ok = most <= width
        if not ok.any():
            break  # a denser word fits only where this one does
        best[ok] = s
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block word offsets, escapes) of ids below 2**32; all blocks are packed side by side."""
    n = len(ids)
    none = np.zeros(0, dtype=np.uint64)
    if not n:
        return none, np.zeros(1, dtype=np.uint32), none.astype(np.uint32)
    blocks = -(-n // BLOCK)
    level = np.full(blocks * BLOCK, 255, dtype=np.uint8)
    level[:n] = _level(ids.astype(np.uint32))
    best = _fits(level.reshape(blocks, BLOCK)).reshape(-1)
    # ids a word takes from each position; an escape word takes the run of escapes up to the block's end
    step = _COUNTS[np.maximum(best, 0)]
    escaped = level == 99
    if escaped.any():
        edge = np.flatnonzero(~escaped | (np.arange(len(level)) % BLOCK == 0))
        stop = np.append(edge, len(level))[np.searchsorted(edge, np.arange(len(level)), side="right")]
        step = np.where(escaped, stop - np.arange(len(level)), step)
    at, end = np.arange(blocks) * BLOCK, np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    first = np.zeros(blocks * BLOCK, dtype=bool)
    while len(at):
        first[at] = True
        at = at + step[at]
        live = at < end
        at, end = at[live], end[live]
    starts = np.flatnonzero(first)
    kinds, low = best[starts], ids.astype(np.uint64)
    words = np.zeros(len(starts), dtype=np.uint64)
    for s in np.unique(kinds[kinds >= 0]).tolist():
        count, width = SELECTORS[s]
        mine = np.flatnonzero(kinds == s)
        word = np.full(len(mine), s << 60, dtype=np.uint64)
        for k in range(count):
            word |= low[starts[mine] + k] << np.uint64(k * width)
        words[mine] = word
    runs = kinds < 0
    words[runs] = np.uint64(ESCAPE << 60) | step[starts[runs]].astype(np.uint64)
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK).astype(np.uint32)
    return words, offsets, ids[escaped[:n]].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of packed words: all words of a selector at once."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    low = words & np.uint64((1 << 60) - 1)
    count = np.where(kind == ESCAPE, low.astype(np.int64), _COUNTS[kind])
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint32)
    for s in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            n = count[mine]
            out[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = escapes
            continue
        c, width = SELECTORS[s]
        out[begin[mine][:, None] + np.arange(c)] = (low[mine][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
    return out


def to_page(doc_ids: np.ndarray, before: np.ndarray, ids: np.ndarray) -> bytes:
    """A page of documents; ``before`` has the ids before each document and in all."""
    words, offsets, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(escapes), len(offsets)], dtype="<u4")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), before.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()])


def from_page(page: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids before each document and in all, ids) of a page."""
    if page[:4] != MAGIC:
        raise ValueError("not a token page")
    docs, n, n_words, n_escapes, blocks = np.frombuffer(page, "<u4", 5, 4).tolist()
    at, parts = 24, []
    for kind, size in (("<i8", docs), ("<u4", docs + 1), ("<u4", blocks), ("<u8", n_words), ("<u4", n_escapes)):
        parts.append(np.frombuffer(page, kind, size, at))
        at += parts[-1].nbytes
    ids = unpack(parts[3], parts[4])
    if len(ids) != n:
        raise ValueError("token page is damaged")
    return parts[0], parts[1], ids


def _ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each range as numbers; shorter ranges have zeros for what is missing."""
    padded = np.concatenate((np.zeros(8, dtype=np.uint8), data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    missing = (8 * np.maximum(8 - (ends - starts), 0)).astype(np.uint64)
    none = missing == 64
    missing[none] = 0
    low, high = eight[starts + 8] << missing, eight[ends] >> missing
    low[none] = high[none] = 0
    return low, high


class Encoder:
    """Byte-level BPE ids of whole texts by the tokenizers library, each chunk encoded once.

    The pre-tokenizer starts a new piece at every space between two other
    characters, so a text is the sequence of its space-led chunks, each encoded
    alone; equal chunks of a batch, told by a hash, their length and 16 of their
    bytes, are looked up once. A chunk of letters is one piece, so those skip the
    pre-tokenizer's pattern. Texts with a chunk that is empty, starts or ends with
    white space, or may hold a special token are encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids of chunks with the space before them, of those used lately and of those before.
        self.most, self.known, self.older = most, {}, {}
        self.leads = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.leads[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        self.ends = dict(zip(".,", self.whole([".", ","]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each text and in all) of UTF-8 texts."""
        joined = b"".join([b" " + t for t in raw])
        data = np.frombuffer(joined, dtype=np.uint8)
        edges = np.cumsum([0, *(len(t) + 1 for t in raw)])
        at = np.flatnonzero(data == 32)
        first = np.searchsorted(at, edges)  # a text's first chunk, its head, has no space before it
        starts, ends = at + 1, np.append(at[1:], len(data)) if len(at) else at
        head = np.zeros(len(at), dtype=bool)
        head[first[:-1]] = True
        h = word_hashes(data, starts, ends)
        h[head] ^= _HEAD
        order = np.argsort(h)
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, dtype=bool)
        one, kind = order[new], np.empty(len(h), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        begins = np.where(head, starts, at)[one]
        values = self._values([joined[i:j] for i, j in zip(begins.tolist(), ends[one].tolist(), strict=True)])
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        odd = sizes == len(_WHOLE)
        bad = odd[kind]
        for x in (ends - starts, *_ends_of(data, starts, ends)):
            bad |= x != x[one][kind]  # two chunks with one hash
        for k in np.flatnonzero(odd).tolist():
            values[k] = b""
        sizes = np.where(odd, 0, sizes // 4)
        begin, n = (np.cumsum(sizes) - sizes)[kind], sizes[kind]
        pool = [b"".join(values)]
        if bad.any():
            odd = np.unique(np.searchsorted(first, np.flatnonzero(bad), side="right") - 1)
            n[np.isin(np.repeat(np.arange(len(raw)), np.diff(first)), odd)] = 0
            pool += self.whole([raw[t].decode("utf-8", "replace") for t in odd.tolist()])
            lengths = np.array([len(x) // 4 for x in pool])
            begin[first[odd]], n[first[odd]] = (np.cumsum(lengths) - lengths)[1:], lengths[1:]
        total = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(total[-1]) + np.repeat(begin - total[:-1], n)
        return np.frombuffer(b"".join(pool), dtype="<u4")[place], total[first]

    def _values(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of every chunk, _WHOLE where the text is to be encoded whole; chunks not used for long are forgotten."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        values = list(map(known.get, chunks))
        open_ = [k for k, v in enumerate(values) if v is None]
        new = [chunks[k] for k in open_]
        if older:
            for c, v in zip(new, list(map(older.get, new)), strict=True):
                if v is not None:
                    known[c] = v
            new = [c for c in new if c not in known]
        self._learn(new)
        for k in open_:
            values[k] = known[chunks[k]]
        return values

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks. Those after a space are joined by spaces: no other token starts with one, so the ids fall apart at those."""
        known, heads, tailed = self.known, [], []
        keys: dict[bool, list[bytes]] = {True: [], False: []}  # of chunks of letters, and of others
        names: dict[bool, list[str]] = {True: [], False: []}
        for key in chunks:
            if key[:1] != b" ":
                heads.append(key)
                continue
            c = key[1:].decode("utf-8", "replace")
            if c.isalpha():
                keys[True].append(key)
                names[True].append(c)
            elif not c or c.strip() != c or "<|" in c:
                known[key] = _WHOLE
            # "word," is "word" and ",": a comma or full stop that ends a chunk after a letter is a piece of its own
            elif len(c) > 2 and c[-1] in ".," and c[-2].isalpha():
                tailed.append(key)
            else:
                keys[False].append(key)
                names[False].append(c)
        for key in {key[:-1] for key in tailed}.difference(keys[True], keys[False]):
            if key not in known:
                c = key[1:].decode("utf-8", "replace")
                keys[c.isalpha()].append(key)
                names[c.isalpha()].append(c)
        for coder, alpha in ((self.letters, True), (self.tokenizer, False)):
            groups = [names[alpha][at : at + 256] for at in range(0, len(names[alpha]), 256)]
            for g, coded in enumerate(coder.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(coded.ids, dtype="<u4")
                cut = [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
                if len(cut) != len(groups[g]) + 1:
                    raise ValueError("a token starts with a space inside a chunk")
                raw = ids.tobytes()
                known.update(zip(keys[alpha][256 * g : 256 * g + 256], map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))
        for key in tailed:
            known[key] = known[key[:-1]] + self.ends[key[-1:].decode()]
        for key in heads:
            c = key.decode("utf-8", "replace")
            known[key] = self.whole([c])[0] if c and not c[-1].isspace() and "<|" not in c else _WHOLE


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives its tasks with all chunks it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, page_bytes: int = 1 << 21) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write pages in ascending doc_id order.

    Rows are range-partitioned and sorted by id; part p holds smaller ids than
    part p + 1. Rows that repeat an id follow each other; a null id comes first
    and is stored as -2**63. Bytes that are no UTF-8 are read as U+FFFD.
    """
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("i"), F.col("text").alias("t"))
    spark = docs.sparkSession
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "i").sortWithinPartitions("i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, page, inside = encoder(tokenizer), 0, 0
        for batch in batches:
            for at, raw in slices(batch, "t", page_bytes):
                ids, before = coder.encode(raw)
                last = before[1:] + np.arange(len(raw))
                text = np.ones(len(ids) + len(raw), dtype=bool)
                text[last] = False
                whole = np.full(len(text), end_id, dtype="<u4")
                whole[text] = ids
                doc_ids, before = batch.column("i").slice(at, len(raw)).to_numpy(zero_copy_only=False), np.append(0, last + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page], pa.int64()), pa.array([inside], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([int(before[-1])], pa.int64()), pa.array([to_page(doc_ids, before, whole)], pa.binary())],
                    ["page", "inside", "n_docs", "n_ids", "body"],
                )
                page, inside = page + 1, inside + int(before[-1])

    pages = ordered.mapInArrow(run, "page long, inside long, n_docs long, n_ids long, body binary")
    pages.select(F.spark_partition_id().alias("part"), "page", "inside", "n_docs", "n_ids", "body").write.mode("overwrite").option("compression", "none").parquet(path)


_PAGES = "part int, page long, inside long, n_docs long, n_ids long, body binary"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the pages; ``start`` counts the ids of all documents before."""
    pages = spark.read.schema(_PAGES).parquet(path)
    return _placed(pages).mapInArrow(_reader(False), "doc_id long, start long, ids array<long>")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the pages."""
    pages = spark.read.schema(_PAGES).parquet(path)
    return _placed(pages).mapInArrow(_reader(True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _placed(pages: DataFrame) -> DataFrame:
    """Pages with the number of ids before them: those before in the part, which the page knows, and those of the parts before."""
    parts = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a part
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return pages.join(F.broadcast(base), "part").select((F.col("base") + F.col("inside")).alias("start"), "body")


def _reader(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column("start").to_pylist(), batch.column("body"), strict=True):
                docs, before, ids = from_page(body.as_py())
                lo = pa.array(np.where(docs == -(2**63), 0, docs), pa.int64(), mask=docs == -(2**63))
                at = before.astype(np.int64)
                columns = [lo, pa.array(start + at[:-1])]
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])

    return run
