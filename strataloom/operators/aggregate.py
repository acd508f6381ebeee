"""Aggregation of raw entities and relations, and upserts of graph nodes and edges.

Row order matters to several results (first seen, last written); it is the
explicit column ``ord``, never the physical order. Blank names and types drop
out. Spellings are normalised once each, not once per row. Groupings by name are
two-level, so that a name a third of all rows share is reduced to its spellings
before it is shuffled by name; relations have one level, whose partial aggregates
are reduced in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import blank, normalize_entity_name, safe_predicate, strip


def _sorted_union(c: str) -> Column:
    """Distinct sorted entries of collected arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def _mode(variants: Column, field: str) -> Column:
    """The most frequent value of a field over (value, n, ord) variants; the first seen among equals."""
    values = F.array_distinct(F.transform(variants, lambda v: v[field]))
    of = lambda x: F.filter(variants, lambda v: v[field] == x)
    total = lambda x: F.aggregate(of(x), F.lit(0).cast("long"), lambda acc, v: acc + v["n"])
    first = lambda x: F.array_min(F.transform(of(x), lambda v: v["ord"]))
    return F.array_max(F.transform(values, lambda x: F.struct(total(x).alias("n"), (-first(x)).alias("first"), x.alias("x"))))["x"]


def aggregate_entities(raw: DataFrame) -> DataFrame:
    """Entities by lower-cased name: commonest name and type, sorted distinct sources, number of rows."""
    name, kind = strip(F.col("nome_entita")), F.col("tipo_entita")
    rows = raw.where(~blank(F.col("nome_entita")) & (kind != "")).withColumns({"name": name, "norm": F.lower(name)})
    variants = rows.groupBy("norm", "name", "tipo_entita").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"),
        F.collect_set(F.nullif(strip(F.col("descrizione_entita")), F.lit(""))).alias("d"), F.collect_set(F.nullif(F.col("source_chunk_id"), F.lit(""))).alias("c"),
        F.collect_set("source_page_number").alias("p"), F.collect_set(F.nullif(F.col("source_section_title"), F.lit(""))).alias("s"),
    )
    grouped = variants.groupBy("norm").agg(
        F.collect_list(F.struct("name", F.col("tipo_entita").alias("kind"), "n", "ord")).alias("v"),
        _sorted_union("d").alias("descrizioni_aggregate"), _sorted_union("c").alias("fonti_chunk_id"), _sorted_union("p").alias("fonti_pagina"), _sorted_union("s").alias("fonti_sezione"),
        F.sum("n").alias("conteggio_occorrenze"),
    )
    distinct = lambda f: F.array_sort(F.array_distinct(F.transform("v", lambda x: x[f])))
    return grouped.select(
        _mode(F.col("v"), "name").alias("nome_entita_canonico_provvisorio"), F.col("norm").alias("nome_entita_norm"), _mode(F.col("v"), "kind").alias("tipo_entita_canonico_provvisorio"),
        distinct("name").alias("tutti_nomi_originali"), distinct("kind").alias("tutti_tipi_rilevati"), "descrizioni_aggregate", "fonti_chunk_id", "fonti_pagina", "fonti_sezione", "conteggio_occorrenze",
    )


def aggregate_entities_legacy(raw: DataFrame) -> DataFrame:
    """The older layout: one row by lower-cased name and type, named as first seen."""
    rows = raw.where(~blank(F.col("nome_entita")) & (F.col("tipo_entita") != "")).withColumn("name", strip(F.col("nome_entita")))
    return rows.groupBy(F.lower("name").alias("nome_entita_norm"), "tipo_entita").agg(
        F.min_by("name", "ord").alias("nome_entita_aggregato"), F.array_sort(F.collect_set(F.nullif(strip(F.col("descrizione_entita")), F.lit("")))).alias("descrizioni"), F.count(F.lit(1)).alias("conteggio_occorrenze")
    )


def upgrade_layout(entities: DataFrame) -> DataFrame:
    """Aggregated entities of either layout in the current one."""
    if "nome_entita_canonico_provvisorio" in entities.columns:
        return entities
    name = F.coalesce("nome_entita_aggregato", "nome_entita_norm", F.lit(""))
    return entities.select(
        name.alias("nome_entita_canonico_provvisorio"), "nome_entita_norm", F.coalesce("tipo_entita", F.lit("")).alias("tipo_entita_canonico_provvisorio"), F.array(name).alias("tutti_nomi_originali"), F.array(F.coalesce("tipo_entita", F.lit(""))).alias("tutti_tipi_rilevati"),
        F.col("descrizioni").alias("descrizioni_aggregate"), *[c for c in ("fonti_chunk_id", "fonti_pagina", "fonti_sezione", "conteggio_occorrenze") if c in entities.columns],
    )


def valid_triples(raw: DataFrame) -> DataFrame:
    """Relations whose three parts are not blank."""
    return raw.where(~blank(F.col("soggetto")) & ~blank(F.col("predicato")) & ~blank(F.col("oggetto")))


def aggregate_relations(raw: DataFrame) -> DataFrame:
    """Relations by their lower-cased parts: sorted distinct contexts and sources, number of rows."""
    key = lambda c: F.lower(strip(F.col(c))).alias(f"{c}_norm")
    text = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    return valid_triples(raw).groupBy(key("soggetto"), key("predicato"), key("oggetto")).agg(
        F.array_sort(F.collect_set(text("contesto_relazione"))).alias("contesti"), F.array_sort(F.collect_set(text("source_chunk_id"))).alias("fonti_chunk_id"), F.array_sort(F.collect_set("source_page_number")).alias("fonti_pagina"),
        F.array_sort(F.collect_set(text("source_section_title"))).alias("fonti_sezione"), F.count(F.lit(1)).alias("conteggio_occorrenze"),
    )


def _once(column: str) -> Column:
    """A grouping's key as a value that hangs on its count ``n``: what is made of it stays above the grouping, once a key."""
    return F.when(F.col("n") > 0, F.col(column))


def merge_nodes_raw(raw: DataFrame) -> DataFrame:
    """Graph nodes by canonical name: the first row sets the fields, original names in first-seen order, number of rows."""
    # rows meet by their spelling, and only its one row is normalised and meets the others of its name
    first = F.min_by(F.struct("tipo_entita", "descrizione_entita", "source_chunk_id", "source_page_number", "source_section_title"), "ord")
    spellings = raw.groupBy("nome_entita").agg(F.count(F.lit(1)).alias("n"), first.alias("f"), F.min("ord").alias("ord"))
    spellings = spellings.withColumn("name", normalize_entity_name(_once("nome_entita"))).where("name != ''")
    grouped = spellings.groupBy("name").agg(F.min_by("f", "ord").alias("f"), F.sum("n").alias("occurrence_count"), F.array_sort(F.collect_list(F.struct("ord", "nome_entita"))).alias("o"))
    return grouped.select(
        "name", F.coalesce("f.tipo_entita", F.lit("Unknown")).alias("type"), F.coalesce("f.descrizione_entita", F.lit("")).alias("description"), F.coalesce("f.source_chunk_id", F.lit("")).alias("source_chunk_id"),
        F.coalesce("f.source_page_number", F.lit(0)).alias("source_page_number"), F.coalesce("f.source_section_title", F.lit("")).alias("source_section_title"), F.transform("o", lambda x: x["nome_entita"]).alias("original_names"), "occurrence_count",
    )


def merge_nodes_clustered(clustered: DataFrame) -> DataFrame:
    """Graph nodes by cluster name: the last row by ``ord`` wins whole."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = clustered.where(~blank(F.col("nome_entita_cluster")))
    last = rows.groupBy(F.col("nome_entita_cluster").alias("name")).agg(F.max_by(F.struct("tipo_entita_cluster", "descrizioni_aggregate", "conteggio_occorrenze_totale", "membri_cluster", "fonti_aggregate_chunk_id"), "ord").alias("l"))
    return last.select(
        "name", F.coalesce("l.tipo_entita_cluster", F.lit("Unknown")).alias("type"), empty("l.descrizioni_aggregate").alias("descriptions"), F.coalesce("l.conteggio_occorrenze_totale", F.lit(0)).alias("occurrence_count"),
        empty("l.membri_cluster").alias("original_members"), empty("l.fonti_aggregate_chunk_id").alias("source_chunk_ids"),
    )


def edges_raw(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per relation whose normalised ends are nodes; relations are not merged.

    Every distinct spelling is normalised once and kept if it names a node; the
    relations meet that small table by their ends' spellings.
    """
    rows = valid_triples(relations)
    spelled = rows.select(F.explode(F.array("soggetto", "oggetto")).alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    named = spelled.select("spelling", normalize_entity_name(_once("spelling")).alias("name")).join(nodes.select("name").distinct(), "name")
    met = rows.withColumn("predicate", safe_predicate(F.col("predicato")))
    for column, end in (("soggetto", "src"), ("oggetto", "dst")):
        met = met.join(named.select(F.col("spelling").alias(column), F.col("name").alias(end)), column)
    return met.select(
        F.col("ord").alias("edge_id"), "src", "dst", "predicate", F.coalesce("contesto_relazione", F.lit("")).alias("context"), F.coalesce("source_chunk_id", F.lit("")).alias("source_chunk_id"),
        F.coalesce("source_page_number", F.lit(0)).alias("source_page_number"), F.coalesce("source_section_title", F.lit("")).alias("source_section_title"), F.col("soggetto").alias("original_subject"), F.col("oggetto").alias("original_object"), F.col("predicato").alias("original_predicate"),
    )


def edges_clustered(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per clustered relation whose ends are nodes; its sources are the clustered ones."""
    names = nodes.select("name")
    rows = relations.where(~blank(F.col("soggetto_cluster")) & ~blank(F.col("predicato_cluster")) & ~blank(F.col("oggetto_cluster")))
    met = rows.join(names.withColumnRenamed("name", "soggetto_cluster"), "soggetto_cluster").join(names.withColumnRenamed("name", "oggetto_cluster"), "oggetto_cluster")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return met.select(
        F.col("soggetto_cluster").alias("src"), F.col("oggetto_cluster").alias("dst"), F.col("predicato_cluster").alias("type"), empty("contesti_aggregati").alias("contexts"), F.coalesce("conteggio_occorrenze_totale", F.lit(0)).alias("occurrence_count"),
        empty("predicati_originali_cluster").alias("original_predicates"), empty("fonti_aggregate_chunk_id").alias("source_chunk_ids"),
    )


def normalization_log(raw: DataFrame) -> DataFrame:
    """(name, originals): canonical names that several differing spellings lead to."""
    rows = raw.groupBy("nome_entita").agg(F.count(F.lit(1)).alias("n")).withColumn("name", normalize_entity_name(_once("nome_entita"))).where((F.col("name") != "") & (F.lower("nome_entita") != F.col("name")))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("nome_entita")).alias("originals")).where(F.size("originals") > 1)


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names that more than one node has; empty when the uniqueness constraint holds."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def predicate_counts(relations: DataFrame) -> DataFrame:
    return valid_triples(relations).groupBy(safe_predicate(F.col("predicato")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def adapt_node_edge_format(responses: DataFrame, normalize=None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of (chunk_id, source_file, page_number, r) where ``r`` has nodes and relationships by id.

    Ids are unique per chunk; the last node of an id gives its name. Edges with an
    unknown end or no type drop out.
    """
    from ..functions.names import collapse_name

    normalize = normalize or collapse_name
    nodes = responses.select("chunk_id", "source_file", "page_number", F.posexplode("r.nodes").alias("pos", "x")).where("x.properties.name != ''")
    entities = nodes.select(
        normalize(F.col("x.properties.name")).alias("nome_entita"), F.coalesce("x.label", F.lit("Unknown")).alias("tipo_entita"), F.coalesce("x.properties.description", F.concat(F.lit("Entità estratta da "), "source_file", F.lit("."))).alias("descrizione_entita"),
        F.col("chunk_id").alias("source_chunk_id"), F.col("page_number").alias("source_page_number"),
    )
    names = nodes.where("x.id IS NOT NULL").groupBy("chunk_id", F.col("x.id").alias("id")).agg(F.max_by("x.properties.name", "pos").alias("name"))
    links = responses.select("chunk_id", "source_file", "page_number", F.explode("r.relationships").alias("e")).where("e.type != ''")
    end = lambda side: names.select("chunk_id", F.col("id").alias(f"{side}_id"), normalize(F.col("name")).alias(side))
    met = links.withColumns({"soggetto_id": F.col("e.start_node_id"), "oggetto_id": F.col("e.end_node_id")}).join(end("soggetto"), ["chunk_id", "soggetto_id"]).join(end("oggetto"), ["chunk_id", "oggetto_id"])
    relations = met.select("soggetto", F.col("e.type").alias("predicato"), "oggetto", F.coalesce("e.properties.context", F.concat(F.lit("Relazione estratta da "), "source_file", F.lit("."))).alias("contesto_relazione"), F.col("chunk_id").alias("source_chunk_id"), F.col("page_number").alias("source_page_number"))
    return entities, relations
