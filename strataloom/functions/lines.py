"""Lines of extracted pages: what kind a line is, cleaning of texts, tables of contents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import fixed_values as fixed
from .names import strip, words


def any_match(text: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    """Whether one of the patterns is found."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(("(?iu)" if ignore_case else "") + joined)


def is_header_footer(line: Column) -> Column:
    return any_match(line, fixed.HEADER_FOOTER) | (F.length(strip(line)) < 5)


def is_figure_caption(line: Column) -> Column:
    return any_match(line, fixed.FIGURE_CAPTION)


def is_table_caption(line: Column) -> Column:
    return any_match(line, fixed.TABLE_CAPTION)


def is_caption(line: Column) -> Column:
    return any_match(line, [*fixed.FIGURE_CAPTION, *fixed.TABLE_CAPTION])


def is_page_reference(line: Column) -> Column:
    return any_match(line, fixed.PAGE_REFERENCE, ignore_case=False)


def is_list_item(line: Column) -> Column:
    return any_match(line, fixed.LIST_ITEM, ignore_case=False)


def _capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def _title_like(line: Column) -> Column:
    own = words(line)
    capital = (F.size(own) > 1) & F.forall(F.slice(own, 1, 3), _capital)
    caption = any_match(F.upper(line), fixed.CAPTION_WORDS, ignore_case=False)
    return any_match(line, fixed.TITLE_WORDS) | (capital & ~caption)


def looks_like_title(line: Column) -> Column:
    """A title word, or several words of which the first three are capitalised and none belongs to captions."""
    return ~is_caption(line) & _title_like(line)


def _all_capitals(line: Column) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line)


def is_section_title(line: Column, avg_size: Column | None = None, bold: Column | None = None) -> Column:
    """A numbered title, capitals throughout, or a title-like line set large or bold; no caption."""
    return ~is_caption(line) & _section_title(line, avg_size, bold)


def _section_title(line: Column, avg_size: Column | None, bold: Column | None) -> Column:
    """``is_section_title`` of a line that is known not to be a caption: that test is the dearest and runs once a line."""
    styled = F.coalesce(avg_size > 12, F.lit(False)) if avg_size is not None else F.lit(False)
    styled = styled | (F.coalesce(bold, F.lit(False)) if bold is not None else F.lit(False))
    capitals = _all_capitals(line) & (F.size(words(line)) > 1) & (F.length(line) < 100)
    return ~is_page_reference(line) & (line.rlike(fixed.NUMBERED_TITLE) | capitals | (styled & _title_like(line)))


def line_kind(line: Column, toc_match: Column, avg_size: Column | None = None, bold: Column | None = None) -> Column:
    """The first of: caption, header_footer, list, toc_title, title, paragraph."""
    return (
        F.when(is_caption(line), "caption").when(is_header_footer(line), "header_footer").when(is_list_item(line), "list")
        .when(toc_match, "toc_title").when(_section_title(line, avg_size, bold), "title").otherwise("paragraph")
    )


def style_average(spans: Column) -> tuple[Column, Column]:
    """(mean font size, whether any is bold) of an array of (text, size, flags)."""
    total = F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["size"], F.lit(0.0)))
    return F.when(F.size(spans) > 0, total / F.size(spans)), F.exists(spans, lambda s: s["flags"].bitwiseAND(16) != 0)


def clean_text(text: Column) -> Column:
    """A page's text without headers, captions, page references and short lines, in one line of single spaces."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~is_header_footer(x) & ~is_caption(x) & ~is_page_reference(x))
    bare = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"^Vers\.\s*\d+\.\d+\s*", ""), r"Pag\.\s*\d+\s*", ""))
    out = F.regexp_replace(F.array_join(F.filter(bare, lambda x: F.length(x) > 10), " "), r"(?U)\s+", " ")
    for pattern, by in (("([a-z])([A-Z])", "$1 $2"), (r"(\d+)([A-Za-z])", "$1 $2"), (r"\s+[.]+\s+", " "), (r"\s+[-]+\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.coalesce(strip(out), F.lit(""))


def token_count(text: Column) -> Column:
    """Words, numbers and single marks: this engine's tokenizer for chunk sizes."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def toc_page(pages: DataFrame, most: int = fixed.TOC_PAGES) -> DataFrame:
    """(file, page_number, text) of each file's table of contents: the first page of its first ``most`` that names one."""
    found = pages.where((F.col("page_number") <= most) & any_match(F.col("text"), fixed.TOC_HEADINGS))
    first = found.groupBy("file").agg(F.min_by(F.struct("page_number", "text"), "page_number").alias("p"))
    return first.select("file", "p.page_number", "p.text")


def toc_of_pages(pages: DataFrame, most: int = fixed.TOC_PAGES) -> DataFrame:
    """The parsed entries of the table of contents of each file of (file, page_number, text); see ``parse_toc``."""
    return parse_toc(toc_page(pages, most).select("file", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")))


def parse_toc(lines: DataFrame) -> DataFrame:
    """TOC entries of (file, ord, line): (file, ord, section_key, title, page, section_number).

    Three shapes of line are tried in order: number, title, page; title, page;
    number, title. A repeated key keeps its first place and its last value.
    """
    full, plain, short = fixed.TOC_NUMBER_TITLE_PAGE, fixed.TOC_TITLE_PAGE, fixed.TOC_NUMBER_TITLE
    line = F.col("line")
    skip = F.lit(False)
    for word in fixed.TOC_SKIP:
        skip = skip | F.contains(F.lower(line), F.lit(word))
    rows = lines.withColumn("line", strip(line)).where((F.length(line) >= 5) & ~skip)
    shape = F.when(line.rlike(full), 1).when(line.rlike(plain), 2).when(line.rlike(short), 3)
    get = lambda pattern, k: F.regexp_extract(line, pattern, k)
    tidy = lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"\s+", " "), "[.]+$", "")
    by = lambda a, b, c: F.when(F.col("shape") == 1, a).when(F.col("shape") == 2, b).otherwise(c)
    found = rows.withColumn("shape", shape).where("shape IS NOT NULL")
    found = found.select(
        "file", "ord", "shape",
        tidy(by(get(full, 2), get(plain, 1), get(short, 2))).alias("title"),
        by(get(full, 3), get(plain, 2), F.lit(None)).try_cast("int").alias("page"),
        F.regexp_replace(by(get(full, 1), F.lit(None), get(short, 1)), r"\.+$", "").alias("section_number"),
    )
    nth = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    keyed = found.withColumn("section_key", F.coalesce("section_number", F.concat(F.lit("section_"), nth.cast("string"))))
    grouped = keyed.groupBy("file", "section_key").agg(F.min("ord").alias("ord"), F.max_by(F.struct("title", "page", "section_number"), "ord").alias("v"))
    return grouped.select("file", "ord", "section_key", "v.title", "v.page", "v.section_number")


def toc_words(title: Column) -> Column:
    stops = F.array(*(F.lit(w) for w in fixed.TOC_STOP_WORDS))
    return F.array_except(F.array_distinct(words(title)), stops)


def match_toc(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """(file, line_id, toc_ord) for (file, line_id, line): the first TOC entry that a line names.

    Exactly, after numbers and caption words are cut, or by sharing words: two of
    them, or the only one of a title. Distinct texts, under numbers, meet titles by
    shared words, the first titles first: texts that have found theirs do not meet
    the later ones. After the first titles a text is looked up by all its words but
    the one that most titles have: who shares two words shares one of those.
    """
    text = F.regexp_replace(strip(F.regexp_replace("line", r"^\d+(\.\d+)*\.?\s*", "")), r"\s+", " ")
    text = F.regexp_replace(F.upper(text), r"^(FIGURA|TABELLA|STEP|F\s+IGURA)\s*\d+\s*[-–]?\s*", "")
    rows = lines.select("file", "line_id", text.alias("_text"))
    entries = cut(toc.select("file", F.regexp_replace(F.upper(strip(F.col("title"))), r"\s+", " ").alias("_title"), "ord").groupBy("file", "_title").agg(F.min("ord").alias("toc_ord")))
    texts = cut(rows.select("file", "_text").distinct().withColumn("_id", F.monotonically_increasing_id()))
    long = entries.where(F.length("_title") > 5).withColumn("_ws", toc_words(F.col("_title"))).where(F.size("_ws") > 0)
    named = cut(long.select("file", "toc_ord", (F.size("_ws") > 1).alias("_two"), F.explode("_ws").alias("_w")))
    low, last = 15, named.where("_two").agg(F.max("toc_ord")).first()[0]

    said = texts.where(F.length("_text") > 5).select("_id", "file", F.explode(toc_words(F.col("_text"))).alias("_w"))
    alone = named.where("NOT _two").groupBy("file", "_w", "_two").agg(F.min("toc_ord").alias("toc_ord"))
    block = cut(alone.unionByName(named.where(F.col("_two") & (F.col("toc_ord") <= low))))
    met = said.join(block, ["file", "_w"]).groupBy("_id", "toc_ord").agg(F.count(F.lit(1)).alias("_n"), F.first("_two").alias("_two")).where("_n > 1 OR NOT _two")
    found = cut(met.groupBy("_id").agg(F.min("toc_ord").alias("toc_ord")))

    open_ = None
    while last is not None and low < last:
        done = found.where(F.col("toc_ord") <= low).select("_id")
        if open_ is None:
            often = cut(named.where("_two").groupBy("file", "_w").agg(F.count(F.lit(1)).alias("_n")))
            known = said.join(done, "_id", "left_anti").join(often, ["file", "_w"]).groupBy("_id", "file").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_ws")).where("size(_ws) > 1")
            open_ = known.select("_id", "file", F.transform(F.slice("_ws", F.lit(1), F.size("_ws") - 1), lambda x: x["_w"]).alias("_ws"), F.element_at("_ws", -1)["_w"].alias("_top"))
        else:
            open_ = open_.join(done, "_id", "left_anti")
        open_ = cut(open_)
        high = low * 4  # a text that meets its title early is offered few of the later ones
        block = named.where(F.col("_two") & (F.col("toc_ord") > low) & (F.col("toc_ord") <= high)).select("file", "_w", "toc_ord")
        near = open_.select("_id", "file", "_top", F.explode("_ws").alias("_w")).join(block, ["file", "_w"]).groupBy("_id", "file", "_top", "toc_ord").agg(F.count(F.lit(1)).alias("_n"))
        has = block.withColumnRenamed("_w", "_top").withColumn("_has", F.lit(1))
        hits = near.join(has, ["file", "_top", "toc_ord"], "left").where("_n + coalesce(_has, 0) > 1").select("_id", "toc_ord")
        found = cut(found.union(hits).groupBy("_id").agg(F.min("toc_ord").alias("toc_ord")))
        low = high
    exact = entries.select("file", F.col("_title").alias("_text"), "toc_ord")
    first = texts.join(found, "_id").select("file", "_text", "toc_ord").union(exact).groupBy("file", "_text").agg(F.min("toc_ord").alias("toc_ord"))
    return rows.join(first, ["file", "_text"]).groupBy("file", "line_id").agg(F.min("toc_ord").alias("toc_ord"))
