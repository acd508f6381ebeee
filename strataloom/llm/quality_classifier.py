"""A quality classifier as a sparse ensemble of rules.

Small boosted trees are grown over text statistics of a bounded sample of
labelled rows. Every path from a root becomes a conjunctive rule; a lasso
logistic fit over the rules keeps few of them; the survivors are compiled into
one Spark column expression, so scoring all documents is a projection.

Labels, language, source and ids are no inputs of a score. Null and empty texts
have zero statistics and are scored like any other row. Without usable labels,
or with one class only, every score is the smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_stats import with_counts, with_counts_beside
from .shared import trim

#: Statistics the trees see, as SQL over the counts.
FEATURES = {
    "log_words": "ln(1D + n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "upper": "n_upper / greatest(n_points, 1)",
    "digits": "n_digits / greatest(n_points, 1)",
    "punct": "n_punct / greatest(n_points, 1)",
    "bang": "n_bang / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "high": "n_high / greatest(n_points, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "top_word": "top_word / greatest(n_words, 1)",
    "short": "n_short / greatest(n_words, 1)",
    "long": "n_long / greatest(n_words, 1)",
    "caps": "n_caps_words / greatest(n_words, 1)",
}

#: Most labelled rows the fit reads; the choice among more is by a hash of the id.
SAMPLE_ROWS = 20_000

Cond = tuple[int, bool, float]  # feature, whether at most, threshold


@dataclass
class RuleModel:
    """Rules with weights; ``score`` compiles them into a Spark column."""

    bias: float
    rules: list[tuple[tuple[Cond, ...], float]] = field(default_factory=list)
    names: tuple[str, ...] = tuple(FEATURES)

    def score(self) -> Column:
        total = repr(float(self.bias)) + "D"
        for conds, weight in self.rules:
            test = " AND ".join(f"{self.names[f]} {'<=' if low else '>'} {t!r}D" for f, low, t in conds)
            total += f" + IF({test}, {weight!r}D, 0D)"
        return F.expr(f"1D / (1D + exp(-({total})))")

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        """The same score over a feature matrix."""
        z = np.full(len(x), self.bias)
        for conds, weight in self.rules:
            z += weight * _holds(conds, x)
        return 1 / (1 + np.exp(-z))


def _holds(conds: tuple[Cond, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, low, t in conds:
        out &= x[:, f] <= t if low else x[:, f] > t
    return out


def _grow(x, bins, cuts, grad, hess, rows, path, depth, least, found) -> list:
    """Leaves (rows, value) of one tree; appends every path below the root to ``found``."""
    if path:
        found.append(tuple(path))
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            b = bins[rows, f]
            g = np.cumsum(np.bincount(b, grad[rows], len(edges) + 1))[:-1]
            h = np.cumsum(np.bincount(b, hess[rows], len(edges) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        return [(rows, -total_g / (total_h + 1))]
    f, k = best[1]
    low = bins[rows, f] <= k
    t = float(cuts[f][k])
    return _grow(x, bins, cuts, grad, hess, rows[low], [*path, (f, True, t)], depth - 1, least, found) + _grow(x, bins, cuts, grad, hess, rows[~low], [*path, (f, False, t)], depth - 1, least, found)


def fit_rows(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 6e-4, most_rules: int = 60) -> RuleModel:
    """Grow trees, turn their paths into rules, keep those a lasso logistic fit weighs."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return RuleModel(bias)
    cuts, bins = [], np.zeros(x.shape, dtype=np.int64)
    for f in range(x.shape[1]):
        own = np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48), method="lower"))
        own = own[own < x[:, f].max()]
        cuts.append(own)
        bins[:, f] = np.searchsorted(own, x[:, f], side="left")
    z, found, least = np.full(n, bias), [], max(5, n // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        for rows, value in _grow(x, bins, cuts, p - y, p * (1 - p), np.arange(n), [], depth, least, found):
            z[rows] += 0.3 * value
    rules = list(dict.fromkeys(found))
    m = np.stack([_holds(r, x) for r in rules], axis=1)
    seen, keep = set(), []
    for i in range(m.shape[1]):  # of rules with the same rows the first (shortest) stays
        key = m[:, i].tobytes()
        if key not in seen:
            seen.add(key)
            keep.append(i)
    rules, m = [rules[i] for i in keep], m[:, keep].astype(np.float32)
    mean = m.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4)).astype(np.float32)
    a = (m - mean) / scale
    step = 4.0 * n / max(1e-9, float(np.linalg.norm(a[:: max(1, n // 4000)], 2) ** 2 * max(1, n // 4000)))
    w, v, b, t = np.zeros(a.shape[1], dtype=np.float32), np.zeros(a.shape[1], dtype=np.float32), bias, 1.0
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(a @ v + b)))
        g = a.T @ (p - y).astype(np.float32) / n
        b -= float((p - y).mean()) * 2
        u = v - step * g
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    order = np.argsort(-np.abs(w))[:most_rules]
    order = order[np.abs(w[order]) > 1e-4]
    weights = w[order] / scale[order]
    return RuleModel(float(b - (weights * mean[order]).sum()), [(rules[i], float(k)) for i, k in zip(order, weights, strict=True)])


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, FEATURES as double) of every row; no shuffle."""
    return with_counts(docs, id_column, text_column).select(id_column, *(F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, sql in FEATURES.items()))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # rows that repeat an id teach once, by the least of their texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    known = features(rows.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    model = fit_rows(known[list(FEATURES)].to_numpy(dtype=np.float64).reshape(len(known), len(FEATURES)), known["y"].to_numpy(dtype=np.float64))
    trim()
    return model


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; no shuffle."""
    return features(docs).select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows scored at least ``threshold``, with the input's columns; no shuffle.

    The row itself travels through the statistics step, so neither ids nor extra
    columns (whatever their names) are matched again afterwards.
    """
    measured = with_counts_beside(docs)
    inputs = F.struct(*(F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, sql in FEATURES.items()))
    scored = measured.select(F.col("_row"), inputs.alias("_x")).select("_row", "_x.*").where(model.score() >= threshold)
    return scored.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
