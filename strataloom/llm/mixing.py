"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is wanted the same fractional number of times,
target / source size. The whole part is certain; the fractions are rounded
dependently: two fractional documents trade word mass at random until one of
them is taken or left, so a source's word total is kept while every document
keeps its expected copies. Trades run inside chunks of bounded length, largest
documents first; each chunk hands at most one fractional residual, usually a
short document, to the next level of a reduction tree, until a source has one
residual, which is rounded to the nearer side. No level gathers more than a
chunk in one place, however large a source is. Random numbers are hashes of ids
and a seed, so reruns agree.

Rows with the same id, source and text are one unit of the rounding: their wanted
copies add up, only the sum's fraction is rounded, and the copies are dealt out so
that no two of them differ by more than one.

Null texts have size 0. A null source is a source of its own, last in order. An
empty table gives an empty result. Sources whose size is 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed, unpacked, written

WEIGHTS = (5, 2, 1)
#: Documents a chunk of the tree holds on average.
CHUNK = 256


def size_of(text: Column) -> Column:
    """Words of a text: maximal runs outside ASCII white space (null: 0).

    Counted from word ends: words begin where white space (or the start) is
    followed by anything else.
    """
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    joined = F.concat(F.lit(" "), flat)
    return F.regexp_count(joined, F.lit(" [^ ]")).cast("long")


def targets(sources: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The fixed point of capping and resharing: every target is
    min(cap, level * weight) for one level, found by ordering the sources by
    cap / weight. One row per source, so one window over all of them is small.
    """
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        ranked.withColumn("goal", F.sum("source_size").over(every) * share[0] / F.lit(share[1]))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open_w"))
        .withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    )
    # the first source that its cap does not bind sets the level of all after it
    level = F.min(F.when(F.col("free"), F.struct("capped", "open_w", "level")))
    laid = laid.withColumn("set", level.over(every))
    return laid.select("source", "source_size", F.when(F.col("free"), F.col("set.level") * F.col("w")).otherwise(F.col("cap")).cast("double").alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(1.0 / (1 << 53))


def _trade(seed: int):
    """Merge of a fold: the held fractional document against the next one.

    State: the held (id, a, p) with a words and fraction p, and the settled
    (id, taken 0/1) so far. Mass a * p moves so that one of the two settles.
    """

    def merge(state: Column, x: Column) -> Column:
        held, done = state["held"], state["done"]
        mass = held["a"] * held["p"]
        total = mass + x["a"] * x["p"]
        # how far the held one can gain and lose, in words
        gain = F.least(held["a"] * (1.0 - held["p"]), x["a"] * x["p"])
        lose = F.least(mass, x["a"] * (1.0 - x["p"]))
        up = _unit(F.lit(seed), held["id"], x["id"]) * (gain + lose) < lose
        held_mass = F.when(up, mass + gain).otherwise(mass - lose)
        other_mass = total - held_mass
        hp, xp = held_mass / held["a"], other_mass / x["a"]
        snap = lambda p: F.when(p <= 1e-9, 0.0).when(p >= 1 - 1e-9, 1.0).otherwise(p)
        hp, xp = snap(hp), snap(xp)
        held_settled = hp.isin(0.0, 1.0)
        settle = lambda who, p: F.struct(who["id"].alias("id"), p.cast("int").alias("extra"))
        keep = lambda who, p: F.struct(who["id"].alias("id"), who["a"].alias("a"), p.alias("p"))
        return F.when(
            held.isNull(), F.struct(keep(x, x["p"]).alias("held"), done.alias("done"))
        ).otherwise(
            F.struct(
                F.when(held_settled & xp.isin(0.0, 1.0), F.lit(None)).when(held_settled, keep(x, xp)).otherwise(keep(held, hp)).alias("held"),
                F.concat(
                    done,
                    F.when(held_settled, F.array(settle(held, hp))).otherwise(F.array().cast("array<struct<id:bigint,extra:int>>")),
                    F.when(~held_settled | xp.isin(0.0, 1.0), F.array(settle(x, xp))).otherwise(F.array().cast("array<struct<id:bigint,extra:int>>")),
                ).alias("done"),
            )
        )

    return merge


def _level(rows: DataFrame, span: int, seed: int) -> DataFrame:
    """One level of the tree over (source, n, id, a, p): (source, n, held, done) per chunk.

    ``n`` is the number of fractional documents of the source at the first
    level; a source has n / span chunks here, so a chunk stays short at any size.
    """
    chunk = F.pmod(F.xxhash64(F.lit(seed), "id"), F.ceil(F.col("n") / F.lit(float(span))).cast("long"))
    grouped = rows.groupBy("source", "n", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct((-F.col("a")).alias("k"), "id", "a", "p"))).alias("xs"))
    none = F.struct(F.lit(None).cast("struct<id:bigint,a:double,p:double>").alias("held"), F.array().cast("array<struct<id:bigint,extra:int>>").alias("done"))
    return grouped.select("source", "n", F.aggregate("xs", none, _trade(seed)).alias("s")).select("source", "n", "s.held", "s.done")


def rounded(rows: DataFrame, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """(id, extra 0/1) for (source, n, id, a, p) with 0 < p < 1, a > 0, unique ids, n rows a source."""
    most = rows.agg(F.max("n")).first()[0] or 0
    done, left, span, level = None, rows, chunk, 0
    while True:
        out = written(_level(left, span, seed + level), "level")
        settled = out.select(F.explode("done").alias("d")).select("d.id", "d.extra")
        done = settled if done is None else done.union(settled)
        left = out.where("held IS NOT NULL").select("source", "n", "held.id", "held.a", "held.p")
        if span >= most:
            break
        span, level = span * chunk, level + 1
    # one residual a source at most: to the nearer side, so the source misses its target by half of one document at most
    last = left.select("id", (F.col("p") >= 0.5).cast("int").alias("extra"))
    return done.union(last)


def _key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _decided(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, part, source, size, source_size, target) of every row, and (key, size, rows, total) of the rows that agree in ``key``.

    ``key`` is a hash of id, source and text, ``part`` deals its rows out to 64
    parts, ``total`` is how often the mix takes them altogether. The texts are read
    once and never shuffled.
    """
    part = (F.monotonically_increasing_id() % 64).cast("int")
    small = written(docs.select(F.col("doc_id"), _key().alias("key"), part.alias("part"), F.col("source"), size_of(F.col("text")).alias("size")), "sizes")
    plan = written(targets(small.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    at = F.broadcast(plan.withColumnRenamed("source", "_s"))  # one row a source
    want = small.join(at, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = want.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.first(ratio).alias("f")).withColumn("wanted", F.col("f") * F.col("rows"))
    units = units.withColumn("sure", F.floor(F.col("wanted") + 1e-9)).withColumn("p", F.col("wanted") - F.floor("wanted"))
    open_ = units.where("size > 0 AND p > 1e-9 AND p < 1 - 1e-9")
    n = F.broadcast(open_.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("n")))
    rows = open_.join(n, F.col("source").eqNullSafe(F.col("_s"))).select("source", "n", F.col("key").alias("id"), F.col("size").cast("double").alias("a"), "p")
    extra = rounded(rows, seed)
    total = (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long")
    return want, written(units.join(extra, units["key"] == extra["id"], "left").select("key", "size", "rows", total.alias("total")), "decisions")


def decisions(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies, taken) of every row."""
    want, decided = _decided(docs, seed)
    out = want.join(decided, ["key", "size"]).withColumn("copies", F.col("total"))
    if decided.where("rows > 1").take(1):
        several = out.where("rows > 1")
        # a row's number among its equals: those of smaller parts, and those before it in its own
        counts = several.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("own"))
        before = counts.select("key", "size", "part", (F.sum("own").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("own")).alias("before"))
        nth = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("doc_id"))
        placed = several.withColumn("nth", nth).join(before, ["key", "size", "part"]).withColumn("nth", F.col("nth") + F.col("before"))
        dealt = F.floor(F.col("total") / F.col("rows")) + (F.col("nth") <= F.col("total") % F.col("rows")).cast("long")
        out = out.where("rows = 1").unionByName(placed.withColumn("copies", dealt).drop("nth", "before"))
    copies = F.col("copies").cast("long")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows the mix takes, repeated as often as it takes them, with the input's columns.

    A row whose size is 0 carries no words; it is kept once. Of rows that agree in
    id, source and text, what is left over when their copies are dealt out evenly
    comes from one of them.
    """
    _, decided = _decided(docs.select("doc_id", "source", "text"), seed)
    each, over = F.floor(F.col("total") / F.col("rows")), F.col("total") % F.col("rows")
    made = decided.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.when(F.col("size") == 0, 1).otherwise(each).cast("int").alias("_each"), F.when(F.col("size") == 0, 0).otherwise(over).cast("int").alias("_over")).where("_each > 0 OR _over > 0")
    rows = packed(docs, k=_key(), n=size_of(F.col("text"))).join(made, (F.col("k") == F.col("_key")) & (F.col("n") == F.col("_size")))
    out = rows.where("_each > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_each"))).alias("copy"))
    if made.where("_over > 0").take(1):
        rest = rows.where("_over > 0").groupBy("k", "n").agg(F.first("_row").alias("_row"), F.first("_over").alias("_over"))
        out = out.union(rest.select("_row", F.explode(F.sequence(F.lit(1), F.col("_over"))).alias("copy")))
    return unpacked(out, docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return decisions(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
