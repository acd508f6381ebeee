"""Documents to chunks: sections that carry forward over pages, and greedy packing of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import CHUNK_TOKENS
from ..functions.lines import token_count
from ..functions.names import blank, strip

#: A sentence ends at a stop, an exclamation or a question mark before white space.
SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), SENTENCE_END), lambda s: s != "")


def section_of_page(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """``pages`` (file, page_number) with the title of the TOC entry of the greatest page not above theirs, the first in TOC order among equals.

    Pages and entries of a file go through one window in order of their pages.
    """
    entries = toc.where("page > 0").groupBy("file", F.col("page").alias("at")).agg(F.min_by(F.struct("title"), "ord").alias("entry"))
    asked = pages.select("file", F.col("page_number").alias("at"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry")).distinct()
    both = entries.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    upto = Window.partitionBy("file").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("entry", F.last("entry", ignorenulls=True).over(upto)).where("asked").select("file", F.col("at").alias("page_number"), F.col("entry.title").alias("section_title"))


def carry_forward(lines: DataFrame, order: list[str]) -> DataFrame:
    """(file, ..., title) rows in order: ``section`` is the last title seen in the file, ``section_no`` counts its changes."""
    upto = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("section", F.last("title", ignorenulls=True).over(upto))
    before = F.lag("section").over(Window.partitionBy("file").orderBy(*order))
    changed = (F.col("section").isNotNull() & ~F.col("section").eqNullSafe(before)).cast("long")
    return carried.withColumn("_changed", changed).withColumn("section_no", F.sum("_changed").over(upto)).drop("_changed")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``n``: the row's number within its file, from 0."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)


def pack(items: Column, most: int = CHUNK_TOKENS) -> Column:
    """Sentences joined greedily into chunks of at most ``most`` tokens, in order.

    A chunk is closed when the next sentence would make it too long; a sentence
    that is too long by itself is a chunk. Token counts add up over sentences, so
    the fold carries a sum instead of counting the joined text again; a sentence is
    counted once, before the fold, whose step names its count several times.
    """
    items = F.transform(items, lambda s: F.struct(s.alias("s"), token_count(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(state: Column, item: Column) -> Column:
        s, n = item["s"], item["n"]
        full = (state["n"] + n > most) & (state["now"] != "")
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["now"] == ""), s).otherwise(F.concat(state["now"], F.lit(" "), s)).alias("now"),
            F.when(full, n).otherwise(state["n"] + n).alias("n"),
        )

    return F.aggregate(items, start, step, lambda state: F.filter(F.concat(state["done"], F.array(state["now"])), lambda c: c != ""))


def sentence_chunks(pages: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """(chunk_id, text, source_file, page_number, chunk_type, word_count) of (file, page_number, text), page by page.

    Ids hold the page, so that pages of a file do not collide.
    """
    rows = pages.where(~blank(F.col("text"))).select("file", "page_number", F.posexplode(pack(sentences(F.col("text")), most)).alias("n", "text"))
    return rows.select(
        F.concat_ws("_", "file", F.lit("page"), F.col("page_number").cast("string"), F.lit("chunk"), F.col("n").cast("string")).alias("chunk_id"), "text", F.col("file").alias("source_file"), "page_number",
        F.lit("sentence_based").alias("chunk_type"), token_count(F.col("text")).alias("word_count"),
    )


def section_chunks(pages: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of (file, page_number, section_title, text) by section: a section's pages are joined, then packed.

    The page of a chunk is the last one of its section. A file's sections follow
    each other; chunks are numbered over the file.
    """
    runs = carry_forward(pages.withColumn("title", F.col("section_title")), ["page_number"])
    joined = runs.groupBy("file", "section_no").agg(
        F.first("section").alias("section_title"), F.max("page_number").alias("page_number"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), " ").alias("text"),
    )
    cut = joined.where(~blank(F.col("text"))).withColumn("parts", pack(sentences(F.col("text")), most))
    rows = numbered(cut.select("file", "section_no", "section_title", "page_number", F.size("parts").alias("of"), F.posexplode("parts").alias("pos", "text")), ["section_no", "pos"])
    return rows.select(
        F.concat(F.col("file"), F.lit("_section_"), F.col("n").cast("string")).alias("chunk_id"), "text", F.col("file").alias("source_file"), "page_number", "section_title",
        F.when(F.col("pos") < F.col("of") - 1, "toc_section_split").otherwise("toc_section").alias("chunk_type"), token_count(F.col("text")).alias("word_count"),
    )


def choose_chunks(by_section: DataFrame, by_sentence: DataFrame) -> DataFrame:
    """A file's section chunks if it has any, else its sentence chunks."""
    with_sections = by_section.select("source_file").distinct()
    return by_section.unionByName(by_sentence.join(with_sections, "source_file", "left_anti"), allowMissingColumns=True)


def join_by_file(chunks: DataFrame) -> DataFrame:
    """(source_file, text): a file's non-empty texts in order, each followed by an empty line."""
    rows = chunks.where((F.col("source_file") != "") & (F.col("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("source_file").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n\n"))), "").alias("text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, those from a TOC, those with a title, mean words, distinct types and titles."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.startswith("chunk_type", F.lit("toc"))).alias("n_toc"), F.count("section_title").alias("n_titled"), F.round(F.avg("word_count"), 6).alias("mean_words"),
        F.array_sort(F.collect_set("chunk_type")).alias("types"), F.count_distinct("section_title").alias("n_titles"),
    )
