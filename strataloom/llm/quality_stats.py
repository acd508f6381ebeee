"""Per-document statistics over whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import WHITE, slices, window_hashes, word_hashes, words

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_PUNCT = np.zeros(256, dtype=np.int64)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_BANG = np.zeros(256, dtype=np.int64)
_BANG[33] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[46] = 1
_HIGH = np.zeros(256, dtype=np.int64)
_HIGH[128:] = 1
#: Bytes that begin a code point.
_POINT = np.ones(256, dtype=np.int64)
_POINT[128:192] = 0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_bang", "n_stops", "n_high", "n_distinct", "n_points", "top_word", "n_short", "n_long", "n_caps_words")


def _per_text(lut: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lut[data], out=total[1:])
    return total[edges[1:] - 1] - total[edges[:-1]]  # the joining line end is no part of a text


def measure(texts: list[bytes], wide: bool = True) -> dict[str, np.ndarray]:
    """The counts of COUNTS (only the first five and n_lines unless ``wide``) of each text."""
    n = len(texts)
    data, starts, ends, first = words(texts)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    out = {"n_words": np.diff(first)}
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_POINT[data], out=points[1:])
    chars = points[ends] - points[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    run = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(chars, out=run[1:])
    out["word_chars"] = run[first[1:]] - run[first[:-1]]
    out["n_symbols"] = _per_text(_SYMBOL, data, edges)
    h = word_hashes(data, starts, ends)
    dup_lines, repeats = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    windows = window_hashes(h, 5)
    if len(windows):
        text_of = np.repeat(np.arange(n), np.diff(first))
        whole = text_of[: len(windows)] == text_of[4:]
        at = np.flatnonzero(whole)
        tagged = windows[at] ^ (text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(tagged, kind="stable")
        tie = tagged[order][1:] == tagged[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][tie]] = True
        again[order[:-1][tie]] = True
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + 5, -1)
        covered = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(np.cumsum(cover)[:-1] > 0, out=covered[1:])
        repeats = covered[first[1:]] - covered[first[:-1]]
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(WHITE)]
            dup_lines[i] = len(lines) - len(set(lines))
    out |= {"n_dup_lines": dup_lines, "n_repeat_words": repeats}
    if not wide:
        return out
    out["n_lines"] = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    for name, lut in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT), ("n_bang", _BANG), ("n_stops", _STOP), ("n_high", _HIGH)):
        out[name] = _per_text(lut, data, edges)
    out["n_points"] = points[edges[1:] - 1] - points[edges[:-1]]
    distinct, top = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(n):
        if first[i + 1] > first[i]:
            own = np.sort(h[first[i] : first[i + 1]])
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            distinct[i], top[i] = len(cut) - 1, np.diff(cut).max()
    out |= {"n_distinct": distinct, "top_word": top}
    caps = _UPPER[data[starts]] if len(starts) else np.zeros(0, dtype=np.int64)
    for name, flag in (("n_short", chars <= 2), ("n_long", chars >= 14), ("n_caps_words", caps)):
        run = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(flag, out=run[1:])
        out[name] = run[first[1:]] - run[first[:-1]]
    return out


def with_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", wide: bool = True) -> DataFrame:
    """(id, counts of COUNTS as long) of every row; null texts count as empty. No shuffle."""
    names = COUNTS if wide else COUNTS[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "t"):
                got = measure(texts, wide)
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(at, len(texts)), *(pa.array(got[c], pa.int64()) for c in names)], ["i", *names])

    schema = "i long, " + ", ".join(f"{c} long" for c in names)
    return docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_column)


def with_counts_beside(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(_row struct of all input columns, counts of COUNTS): the statistics beside whole rows. No shuffle."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_column).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "t"):
                got = measure(texts)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(at, len(texts)), *(pa.array(got[c], pa.int64()) for c in COUNTS)], ["_row", *COUNTS])

    schema = StructType([packed.schema["_row"], *(StructField(c, LongType()) for c in COUNTS)])
    return packed.mapInArrow(run, schema)
