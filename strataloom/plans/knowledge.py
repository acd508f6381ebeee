"""Queries that aggregate, cluster and load a knowledge graph, and those on chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.lines import token_count
from ..operators import aggregate, chunking, cluster, retrieve
from ..sources import writers
from .catalog import register
from .tables import ENTITIES, FILE, LINES, MENTIONS, RELATIONS, clean_sql, file_of, lines, mentions, normal_sql, raw_entities, raw_relations, strip_sql, table

_AGGREGATED = f"""e AS (SELECT *, lower(nome_entita) AS norm FROM {ENTITIES}),
nm AS (SELECT norm, nome_entita AS v FROM e GROUP BY norm, nome_entita QUALIFY row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, min(ord)) = 1),
tm AS (SELECT norm, tipo_entita AS v FROM e GROUP BY norm, tipo_entita QUALIFY row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, min(ord)) = 1),
a AS (SELECT norm, list_sort(list(DISTINCT nome_entita)) AS tutti_nomi_originali, list_sort(list(DISTINCT tipo_entita)) AS tutti_tipi_rilevati, list_sort(coalesce(list(DISTINCT descrizione_entita) FILTER (WHERE descrizione_entita IS NOT NULL), [])) AS descrizioni_aggregate,
  list_sort(list(DISTINCT source_chunk_id)) AS fonti_chunk_id, list_sort(list(DISTINCT source_page_number)) AS fonti_pagina, list_sort(list(DISTINCT source_section_title)) AS fonti_sezione, count(*) AS conteggio_occorrenze FROM e GROUP BY norm),
agg AS (SELECT nm.v AS nome_entita_canonico_provvisorio, a.norm AS nome_entita_norm, tm.v AS tipo_entita_canonico_provvisorio, a.* EXCLUDE (norm) FROM a JOIN nm USING (norm) JOIN tm USING (norm))"""


@register(f"WITH {_AGGREGATED} SELECT * FROM agg")
def entity_aggregate(spark, sf_dir):
    return aggregate.aggregate_entities(raw_entities(spark, sf_dir))


@register(f"""SELECT lower(nome_entita) AS nome_entita_norm, tipo_entita, arg_min(nome_entita, ord) AS nome_entita_aggregato, list_sort(coalesce(list(DISTINCT descrizione_entita) FILTER (WHERE descrizione_entita IS NOT NULL), [])) AS descrizioni, count(*) AS conteggio_occorrenze FROM {ENTITIES} GROUP BY 1, 2""")
def entity_aggregate_legacy(spark, sf_dir):
    return aggregate.aggregate_entities_legacy(raw_entities(spark, sf_dir))


_RELATIONS_AGGREGATED = f"""(SELECT lower(soggetto) AS soggetto_norm, lower(predicato) AS predicato_norm, lower(oggetto) AS oggetto_norm, list_sort(coalesce(list(DISTINCT contesto_relazione) FILTER (WHERE contesto_relazione IS NOT NULL), [])) AS contesti, list_sort(list(DISTINCT source_chunk_id)) AS fonti_chunk_id,
list_sort(list(DISTINCT source_page_number)) AS fonti_pagina, list_sort(list(DISTINCT source_section_title)) AS fonti_sezione, count(*) AS conteggio_occorrenze FROM {RELATIONS} GROUP BY 1, 2, 3)"""


@register(f"SELECT * FROM {_RELATIONS_AGGREGATED}")
def relation_aggregate(spark, sf_dir):
    return aggregate.aggregate_relations(raw_relations(spark, sf_dir))


_MERGED = f"""e AS (SELECT *, {clean_sql('nome_entita')} AS x FROM {ENTITIES}), m AS (SELECT *, {normal_sql('x')} AS name FROM e),
o AS (SELECT name, list(nome_entita ORDER BY first) AS original_names FROM (SELECT name, nome_entita, min(ord) AS first FROM m WHERE name <> '' GROUP BY 1, 2) GROUP BY name),
f AS (SELECT * FROM m WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1), c AS (SELECT name, count(*) AS occurrence_count FROM m GROUP BY name),
nodes AS (SELECT name, tipo_entita AS type, coalesce(descrizione_entita, '') AS description, source_chunk_id, source_page_number, source_section_title, original_names, occurrence_count FROM f JOIN o USING (name) JOIN c USING (name))"""


@register(f"WITH {_MERGED} SELECT * FROM nodes")
def merge_nodes_raw(spark, sf_dir):
    return aggregate.merge_nodes_raw(raw_entities(spark, sf_dir))


@register(f"WITH {_MERGED} SELECT name, count(*) AS n FROM nodes GROUP BY name HAVING count(*) > 1")
def unique_name_check(spark, sf_dir):
    return aggregate.duplicate_names(aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)))


@register(f"""WITH e AS (SELECT nome_entita, {clean_sql('nome_entita')} AS x FROM {ENTITIES}), m AS (SELECT nome_entita, {normal_sql('x')} AS name FROM e)
SELECT name, list_sort(list(DISTINCT nome_entita)) AS originals FROM m WHERE name <> '' AND lower(nome_entita) <> name GROUP BY name HAVING count(DISTINCT nome_entita) > 1""")
def normalization_log(spark, sf_dir):
    return aggregate.normalization_log(raw_entities(spark, sf_dir))


@register(f"SELECT translate(replace(replace(predicato, ' ', '_'), '''', ''), 'àèìòùÉ', 'aeiouE') AS predicate, count(*) AS n FROM {RELATIONS} GROUP BY 1")
def predicate_counts(spark, sf_dir):
    return aggregate.predicate_counts(raw_relations(spark, sf_dir))


@register(f"""WITH r AS (SELECT *, {clean_sql('soggetto')} AS sx, {clean_sql('oggetto')} AS ox FROM {RELATIONS}), n AS (SELECT *, {normal_sql('sx')} AS src, {normal_sql('ox')} AS dst FROM r), e AS (SELECT {clean_sql('nome_entita')} AS x FROM {ENTITIES}), k AS (SELECT DISTINCT {normal_sql('x')} AS name FROM e)
SELECT ord AS edge_id, src, dst, translate(replace(replace(predicato, ' ', '_'), '''', ''), 'àèìòùÉ', 'aeiouE') AS predicate, coalesce(contesto_relazione, '') AS context, source_chunk_id, source_page_number, source_section_title, soggetto AS original_subject, oggetto AS original_object, predicato AS original_predicate
FROM n JOIN k a ON src = a.name JOIN k b ON dst = b.name""")
def edges_raw(spark, sf_dir):
    return aggregate.edges_raw(raw_relations(spark, sf_dir), aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)))


# Clusters as a model would give them: parts of a brand, named by it; a part's number is its index.
_PARTS = "(SELECT p_partkey AS idx, p_brand, p_type, [p_name, upper(p_name)] AS tutti_nomi_originali, [p_type] AS tutti_tipi_rilevati, ['d' || p_size] AS descrizioni_aggregate, ['c' || (p_partkey % 50)] AS fonti_chunk_id, CAST(p_size AS BIGINT) AS conteggio_occorrenze FROM part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), "p_brand", "p_type", F.array(F.col("p_name"), F.upper("p_name")).alias("tutti_nomi_originali"), F.array("p_type").alias("tutti_tipi_rilevati"), F.array(F.concat(F.lit("d"), F.col("p_size").cast("string"))).alias("descrizioni_aggregate"),
        F.array(F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string"))).alias("fonti_chunk_id"), F.col("p_size").cast("long").alias("conteggio_occorrenze"), F.col("p_name").alias("nome_entita_canonico_provvisorio"), F.col("p_type").alias("tipo_entita_canonico_provvisorio"),
    )


_CLUSTERS = "(SELECT p_brand AS cluster_id, p_brand AS nome_cluster, 'Criterio' AS tipo_cluster, list_sort(list(CAST(p_partkey AS INTEGER))) AS membri_ids FROM part GROUP BY p_brand)"


def _clusters(spark, sf_dir):
    ids = F.array_sort(F.collect_list(F.col("p_partkey").cast("int")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.first("p_brand").alias("nome_cluster"), F.lit("Criterio").alias("tipo_cluster"), ids.alias("membri_ids"))


_MERGED_CLUSTERS = f"""(SELECT p_brand AS nome_entita_cluster, 'Criterio' AS tipo_entita_cluster, list_sort(list_distinct(flatten(list(tutti_nomi_originali)))) AS membri_cluster, list_sort(list_distinct(flatten(list(tutti_tipi_rilevati)))) AS tipi_membri_cluster,
list_sort(list_distinct(flatten(list(descrizioni_aggregate)))) AS descrizioni_aggregate, list_sort(list_distinct(flatten(list(fonti_chunk_id)))) AS fonti_aggregate_chunk_id, CAST(sum(conteggio_occorrenze) AS BIGINT) AS conteggio_occorrenze_totale, list_sort(list(CAST(idx AS INTEGER))) AS membri_ids_originali FROM {_PARTS} GROUP BY p_brand)"""


@register(f"SELECT * FROM {_MERGED_CLUSTERS}")
def cluster_merge(spark, sf_dir):
    return cluster.merge_clusters(_clusters(spark, sf_dir), _parts(spark, sf_dir)).drop("cluster_id")


@register(f"SELECT idx, nome_entita_canonico_provvisorio FROM (SELECT p_partkey AS idx, p_name AS nome_entita_canonico_provvisorio, p_brand FROM part) WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1%')")
def cluster_leftovers(spark, sf_dir):
    held = _clusters(spark, sf_dir).where(F.contains("nome_cluster", F.lit("1")))
    return cluster.leftovers(_parts(spark, sf_dir), held).select("idx", "nome_entita_canonico_provvisorio")


@register("SELECT p_name AS nome_entita_cluster, p_type AS tipo_entita_cluster, [p_name, upper(p_name)] AS membri_cluster, [CAST(p_partkey AS INTEGER)] AS membri_ids_originali FROM part")
def cluster_singletons(spark, sf_dir):
    return cluster.singletons(_parts(spark, sf_dir)).select("nome_entita_cluster", "tipo_entita_cluster", "membri_cluster", "membri_ids_originali")


@register("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS nome_principale, ['d' || p_size] AS descrizioni, CAST(floor(p_partkey / 15) AS BIGINT) AS batch FROM part")
def clustering_inputs(spark, sf_dir):
    rows = cluster.batches(cluster.entity_inputs(_parts(spark, sf_dir)).withColumn("idx", F.col("id")), fixed.ENTITY_BATCH)
    return rows.select("id", "nome_principale", "descrizioni", "batch")


@register(f"SELECT soggetto_norm AS soggetto, predicato_norm AS predicato, oggetto_norm AS oggetto, contesti[1:1] AS contesti, conteggio_occorrenze AS occorrenze FROM {_RELATIONS_AGGREGATED}")
def clustering_relation_inputs(spark, sf_dir):
    rows = aggregate.aggregate_relations(raw_relations(spark, sf_dir)).withColumn("idx", F.lit(0))
    return cluster.relation_inputs(rows).drop("id")


# In the runs of 15 parts a cluster (p, p + 1) is offered for every part p; greedy acceptance keeps every other one.
@register("""WITH p AS (SELECT p_partkey AS id, p_partkey // 15 AS batch, row_number() OVER (PARTITION BY p_partkey // 15 ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_partkey // 15) AS n FROM part) SELECT CAST(batch AS BIGINT) AS batch, CAST(id AS BIGINT) AS ord FROM p WHERE r % 2 = 1""")
def greedy_clusters(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    offered = cluster.batches(parts, fixed.ENTITY_BATCH).select("batch", F.col("idx").cast("long").alias("ord"), F.array(F.col("idx").cast("int"), (F.col("idx") + 1).cast("int")).alias("membri_ids"))
    return cluster.accept_greedily(offered).select("batch", "ord")


# Relations of suppliers to parts, one a pair of their keys; those with the same supplier and size class are one cluster.
_LINKED = "(SELECT CAST(row_number() OVER (ORDER BY s, p) AS BIGINT) AS idx, 'supplier ' || s AS soggetto_norm, CASE WHEN p % 2 = 0 THEN 'fornisce' ELSE 'vende' END AS predicato_norm, 'part ' || p AS oggetto_norm, ['x' || (p % 3)] AS contesti, ['c' || (p % 50), ''] AS fonti_chunk_id, ['s' || (s % 7)] AS fonti_sezione, n AS conteggio_occorrenze, s, p FROM (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2))"


def _linked(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("conteggio_occorrenze"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return cluster.numbered(pairs, ["s", "p"]).select(
        "idx", text("supplier ", F.col("s")).alias("soggetto_norm"), F.when(F.col("p") % 2 == 0, "fornisce").otherwise("vende").alias("predicato_norm"), text("part ", F.col("p")).alias("oggetto_norm"), F.array(text("x", F.col("p") % 3)).alias("contesti"),
        F.array(text("c", F.col("p") % 50), F.lit("")).alias("fonti_chunk_id"), F.array(text("s", F.col("s") % 7)).alias("fonti_sezione"), "conteggio_occorrenze", "s", "p",
    )


@register(f"""WITH r AS (SELECT * FROM {_LINKED}), names AS (SELECT lower('Supplier ' || s_suppkey) AS member, arg_max('Fornitore ' || s_nationkey, s_suppkey) AS canonical FROM supplier GROUP BY 1),
m AS (SELECT 'Fornitore ' || (s % 5) AS soggetto_cluster, 'fornisce' AS predicato_cluster, 'classe ' || (p % 11) AS oggetto_cluster, list_sort(list_distinct(flatten(list(contesti)))) AS contesti_aggregati, list_sort(list_filter(list_distinct(flatten(list(fonti_chunk_id))), lambda x: x <> '')) AS fonti_aggregate_chunk_id,
  list_sort(list_distinct(flatten(list(fonti_sezione)))) AS fonti_aggregate_sezione, list_sort(list_distinct(list(predicato_norm))) AS predicati_originali_cluster, CAST(sum(conteggio_occorrenze) AS BIGINT) AS conteggio_occorrenze_totale, list_sort(list(CAST(idx AS INTEGER))) AS membri_ids_originali FROM r WHERE p % 3 > 0 GROUP BY s % 5, p % 11)
SELECT * FROM m UNION ALL SELECT coalesce(canonical, soggetto_norm), predicato_norm, oggetto_norm, contesti, fonti_chunk_id, fonti_sezione, [predicato_norm], conteggio_occorrenze, [CAST(idx AS INTEGER)] FROM r LEFT JOIN names ON soggetto_norm = member WHERE p % 3 = 0""")
def relation_clusters(spark, sf_dir):
    relations = _linked(spark, sf_dir)
    grouped = relations.where("p % 3 > 0").groupBy((F.col("s") % 5).alias("a"), (F.col("p") % 11).alias("b")).agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("membri_ids"))
    clusters = grouped.select(
        (F.col("a") * 11 + F.col("b")).alias("cluster_id"), F.concat(F.lit("Fornitore "), F.col("a").cast("string")).alias("soggetto_cluster"), F.lit("fornisce").alias("predicato_cluster"), F.concat(F.lit("classe "), F.col("b").cast("string")).alias("oggetto_cluster"), "membri_ids"
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("Fornitore "), F.col("s_nationkey").cast("string")).alias("nome_entita_cluster"), F.array(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"))).alias("membri_cluster"))
    return cluster.finalize_relations(clusters, relations.drop("s", "p"), cluster.canonical_names(suppliers))


# One call for 15 entities and 30 relations; the provider tells what it was shown, and fails on every seventh call.
@register(f"""WITH e AS (SELECT CAST(floor(p_partkey / 15) AS BIGINT) AS batch, count(*) AS n_entities FROM part GROUP BY 1), r AS (SELECT CAST(floor(idx / 30) AS BIGINT) AS batch, count(*) AS n_relations FROM {_LINKED} GROUP BY 1)
SELECT coalesce(e.batch, r.batch) AS batch, coalesce(n_entities, 0) AS n_entities, coalesce(n_relations, 0) AS n_relations FROM e FULL JOIN r ON e.batch = r.batch WHERE coalesce(e.batch, r.batch) % 7 > 0""")
def cluster_calls(spark, sf_dir):
    import pandas as pd

    def provider(entities: pd.DataFrame, relations: pd.DataFrame) -> pd.DataFrame:
        batch = int((entities if len(entities) else relations)["batch"].iloc[0])
        if batch % 7 == 0:
            raise RuntimeError("no answer")
        return pd.DataFrame([(batch, len(entities), len(relations))], columns=["batch", "n_entities", "n_relations"])

    return cluster.cluster_together(_parts(spark, sf_dir).select("idx"), _linked(spark, sf_dir).select("idx"), provider, "batch long, n_entities long, n_relations long")


@register("""WITH c AS (SELECT lower(c_name) AS member, arg_max(c_mktsegment, c_custkey) AS canonical FROM customer GROUP BY 1)
SELECT o_orderkey, coalesce(a.canonical, s) AS soggetto_cluster, coalesce(b.canonical, o) AS oggetto_cluster FROM (SELECT o_orderkey, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS s, o_orderpriority AS o FROM orders) LEFT JOIN c a ON lower(s) = a.member LEFT JOIN c b ON lower(o) = b.member""")
def relation_remap(spark, sf_dir):
    clustered = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("nome_entita_cluster"), F.array("c_name").alias("membri_cluster"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("soggetto_norm"), F.col("o_orderpriority").alias("oggetto_norm"))
    return cluster.remap_relations(orders, cluster.canonical_names(clustered)).select("o_orderkey", "soggetto_cluster", "oggetto_cluster")


_CLUSTERED = "(SELECT p_partkey AS ord, p_brand AS nome_entita_cluster, p_type AS tipo_entita_cluster, CAST(p_size AS BIGINT) AS conteggio_occorrenze_totale, [p_name] AS membri_cluster FROM part)"


@register(f"SELECT nome_entita_cluster AS name, arg_max(tipo_entita_cluster, ord) AS type, CAST([] AS VARCHAR[]) AS descriptions, arg_max(conteggio_occorrenze_totale, ord) AS occurrence_count, arg_max(membri_cluster, ord) AS original_members, CAST([] AS VARCHAR[]) AS source_chunk_ids FROM {_CLUSTERED} GROUP BY 1")
def merge_nodes_clustered(spark, sf_dir):
    return aggregate.merge_nodes_clustered(_clustered_parts(spark, sf_dir))


def _clustered_parts(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("nome_entita_cluster"), F.col("p_type").alias("tipo_entita_cluster"), F.col("p_size").cast("long").alias("conteggio_occorrenze_totale"), F.array("p_name").alias("membri_cluster"), none.alias("descrizioni_aggregate"), none.alias("fonti_aggregate_chunk_id")
    )


@register("""WITH b AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_partkey, p_brand AS s, 'Brand#' || (10 + p_partkey % 60) AS o, 'c' || (p_partkey % 50) AS c FROM part)
SELECT s AS src, o AS dst, 'riguarda' AS type, CAST([] AS VARCHAR[]) AS contexts, CAST(1 AS BIGINT) AS occurrence_count, [c] AS source_chunk_ids FROM r JOIN b x ON s = x.p_brand JOIN b y ON o = y.p_brand""")
def edges_clustered(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("soggetto_cluster"), F.lit("riguarda").alias("predicato_cluster"), F.concat(F.lit("Brand#"), (10 + F.col("p_partkey") % 60).cast("string")).alias("oggetto_cluster"), none.alias("contesti_aggregati"), F.lit(1).cast("long").alias("conteggio_occorrenze_totale"), none.alias("predicati_originali_cluster"),
        F.array(F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string"))).alias("fonti_aggregate_chunk_id"),
    )
    nodes = aggregate.merge_nodes_clustered(_clustered_parts(spark, sf_dir))
    return aggregate.edges_clustered(rows, nodes).drop("original_predicates")


@register(f"SELECT ord, soggetto, predicato, oggetto FROM {RELATIONS} WHERE len({strip_sql('soggetto')}) > 0 AND len({strip_sql('oggetto')}) > 0")
def valid_rows(spark, sf_dir):
    return aggregate.valid_triples(raw_relations(spark, sf_dir)).select("ord", "soggetto", "predicato", "oggetto")


@register(f"""SELECT {FILE} AS source_file, string_agg(text || chr(10) || chr(10), '' ORDER BY doc_id) AS text FROM documents WHERE source <> '' AND text <> '' GROUP BY 1""")
def doc_concat(spark, sf_dir):
    return chunking.join_by_file(table(spark, sf_dir, "documents").select(file_of().alias("source_file"), F.col("doc_id").alias("ord"), "text"))


@register(r"""WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'toc_section' ELSE 'sentence_based' END AS chunk_type, CASE WHEN doc_id % 3 > 0 THEN lang END AS section_title, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS word_count FROM documents)
SELECT count(*) AS n_chunks, CAST(count(*) FILTER (WHERE starts_with(chunk_type, 'toc')) AS BIGINT) AS n_toc, count(section_title) AS n_titled, round(avg(word_count), 6) AS mean_words, list_sort(list(DISTINCT chunk_type)) AS types, count(DISTINCT section_title) AS n_titles FROM c""")
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "toc_section").otherwise("sentence_based").alias("chunk_type"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("section_title"), token_count(F.col("text")).alias("word_count"))
    return chunking.chunk_stats(docs)


# Pages are documents numbered within their file; a TOC entry of a file is a document of it in every fifth place.
_PAGES = f"(SELECT {FILE} AS file, CAST(row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) AS INTEGER) AS page_number, doc_id, lang, text FROM documents)"


def _pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(file_of().alias("file"), "doc_id", "lang", "text")
    return chunking.numbered(docs, ["doc_id"]).withColumn("page_number", (F.col("n") + 1).cast("int")).drop("n")


@register(f"""WITH p AS (SELECT * FROM {_PAGES}), t AS (SELECT file, page_number - page_number % 5 AS page, page_number AS ord, 't' || doc_id AS title FROM p WHERE page_number % 5 < 2)
SELECT p.file, p.page_number, arg_max(t.title, t.page * 1000000 - t.ord) AS section_title FROM p LEFT JOIN t ON p.file = t.file AND t.page > 0 AND t.page <= p.page_number GROUP BY p.file, p.page_number""")
def section_asof(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    n = F.col("page_number")
    toc = pages.where(n % 5 < 2).select("file", (n - n % 5).alias("page"), n.alias("ord"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"))
    return chunking.section_of_page(pages.select("file", "page_number"), toc)


@register(f"""WITH p AS (SELECT file, page_number, CASE WHEN page_number % 4 = 0 THEN lang END AS title FROM {_PAGES}), s AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY file ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS section FROM p),
c AS (SELECT *, CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM lag(section) OVER (PARTITION BY file ORDER BY page_number) THEN 1 ELSE 0 END AS changed FROM s)
SELECT file, page_number, section, CAST(sum(changed) OVER (PARTITION BY file ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_no FROM c""")
def section_carry_forward(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("file", "page_number", F.when(F.col("page_number") % 4 == 0, F.col("lang")).alias("title"))
    return chunking.carry_forward(pages, ["page_number"]).select("file", "page_number", "section", "section_no")


@register(f"SELECT doc_id, {FILE} || '_section_' || (row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) - 1) AS chunk_id FROM documents")
def chunk_numbering(spark, sf_dir):
    rows = chunking.numbered(table(spark, sf_dir, "documents").select(file_of().alias("file"), "doc_id"), ["doc_id"])
    return rows.select("doc_id", F.concat("file", F.lit("_section_"), F.col("n").cast("string")).alias("chunk_id"))


@register("""WITH s AS (SELECT source AS source_file, doc_id FROM documents WHERE lang = 'en') SELECT source_file, doc_id, 'section' AS kind FROM s UNION ALL SELECT source, doc_id, 'sentence' FROM documents WHERE source NOT IN (SELECT source_file FROM s)""")
def chunker_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), "doc_id", "lang")
    by_section = docs.where("lang = 'en'").select("source_file", "doc_id", F.lit("section").alias("kind"))
    return chunking.choose_chunks(by_section, docs.select("source_file", "doc_id", F.lit("sentence").alias("kind")))


# Greedy packing in SQL: sentences of a group one after the other, the state being the tokens of the open chunk and its number.
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


def _packed_sql(key: str) -> str:
    """b: (key, k, text) chunks of a table g (key, text)."""
    tokens = _TOKENS.format("s")
    return f"""s AS (SELECT {key}, i, l[i] AS s, {_TOKENS.format('l[i]')} AS n FROM (SELECT {key}, l, unnest(generate_series(1, len(l))) AS i FROM (
  SELECT {key}, list_filter(string_split(regexp_replace({strip_sql('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM g))),
w AS (SELECT {key}, i, s, n, 0 AS k FROM s WHERE i = 1 UNION ALL SELECT {', '.join('s.' + c for c in key.split(', '))}, s.i, s.s, CASE WHEN w.n + s.n > 512 THEN s.n ELSE w.n + s.n END, CASE WHEN w.n + s.n > 512 THEN w.k + 1 ELSE w.k END FROM w JOIN s ON {' AND '.join(f's.{c} = w.{c}' for c in key.split(', '))} AND s.i = w.i + 1),
b AS (SELECT {key}, k, string_agg(s, ' ' ORDER BY i) AS text FROM w GROUP BY {key}, k)"""


@register(f"""WITH RECURSIVE g AS (SELECT file, page_number, text FROM {_PAGES} WHERE len({strip_sql('text')}) > 0), {_packed_sql('file, page_number')}
SELECT file || '_page_' || page_number || '_chunk_' || k AS chunk_id, text, file AS source_file, page_number, 'sentence_based' AS chunk_type, CAST({_TOKENS.format('text')} AS INTEGER) AS word_count FROM b""")
def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(_pages(spark, sf_dir).select("file", "page_number", "text"))


@register(f"""WITH RECURSIVE p AS (SELECT file, page_number, CASE WHEN page_number % 4 = 0 THEN lang END AS title, coalesce(text, '') AS text FROM {_PAGES}), c AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY file ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS section FROM p),
d AS (SELECT *, CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM lag(section) OVER (PARTITION BY file ORDER BY page_number) THEN 1 ELSE 0 END AS changed FROM c), r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY file ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_no FROM d),
g AS (SELECT file, section_no, any_value(section) AS section_title, max(page_number) AS page_number, string_agg(text, ' ' ORDER BY page_number) AS text FROM r GROUP BY file, section_no), {_packed_sql('file, section_no')}
SELECT b.file || '_section_' || (row_number() OVER (PARTITION BY b.file ORDER BY b.section_no, k) - 1) AS chunk_id, b.text, b.file AS source_file, page_number, section_title, CASE WHEN k < max(k) OVER (PARTITION BY b.file, b.section_no) THEN 'toc_section_split' ELSE 'toc_section' END AS chunk_type, CAST({_TOKENS.format('b.text')} AS INTEGER) AS word_count
FROM b JOIN g USING (file, section_no)""")
def section_chunks(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    titled = pages.select("file", "page_number", F.when(F.col("page_number") % 4 == 0, F.col("lang")).alias("section_title"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.section_chunks(titled)


@register(f"SELECT source || '_' || ln AS chunk_id, CAST(coalesce(CASE WHEN ln % 2 = 0 THEN ln END, 0) AS INTEGER) AS page_number FROM (SELECT source, ln FROM {LINES} GROUP BY source, ln)")
def chunk_store(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.concat_ws("_", "source", F.col("ln").cast("string")).alias("chunk_id"), F.when(F.col("ln") % 2 == 0, F.col("ln")).alias("page_number"))
    return writers.chunk_table(rows)


@register(f"""SELECT doc_id, name AS nome_entita, pos, source AS source_file FROM {MENTIONS} WHERE name <> '' AND doc_id % 9 > 0""")
def extract_stub(spark, sf_dir):
    """An extraction provider that finds the long words of a chunk; it fails for good on some chunks and at first on all others."""
    import pandas as pd
    import regex

    word = regex.compile(r"\p{L}{6,}")
    tried = set()

    def provider(frame: pd.DataFrame) -> pd.DataFrame:
        key = tuple(frame["doc_id"])
        first = key not in tried
        tried.add(key)
        if first or any(d % 9 == 0 for d in key):
            raise TimeoutError("no answer")
        found = [word.findall(t) for t in frame["text"]]
        rows = [i for i, ws in zip(frame.index, found, strict=True) for _ in ws]
        return pd.DataFrame({"doc_id": frame["doc_id"].loc[rows].to_numpy(), "nome_entita": [w for ws in found for w in ws], "pos": [k for ws in found for k in range(len(ws))]}, index=rows)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_file"))
    return cluster.extract_in_batches(docs, provider, "doc_id long, nome_entita string, pos int", ["source_file"], size=1)


# Vectors of texts by an offline provider: lengths and counts. Texts the provider fails on stay without one.
@register("SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id % 10 > 0 THEN [CAST(len(text) AS FLOAT), CAST(len(text) - len(replace(text, ' ', '')) AS FLOAT)] END AS embedding FROM documents")
def embed_texts(spark, sf_dir):
    def provider(texts: list[str]) -> list[list[float] | None]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieve.embed(docs, provider, F.when(F.col("doc_id") % 10 > 0, F.col("text"))).select("doc_id", "embedding")


@register(f"SELECT 'raw' AS stage, count(*) AS n FROM {MENTIONS} UNION ALL SELECT 'aggregated', count(DISTINCT lower(name)) FROM {MENTIONS} UNION ALL SELECT 'clustered', count(DISTINCT left(lower(name), 3)) FROM {MENTIONS}")
def funnel_counts(spark, sf_dir):
    from ..operators.evaluate import funnel

    rows = mentions(spark, sf_dir)
    return funnel(raw=rows, aggregated=rows.select(F.lower("name")).distinct(), clustered=rows.select(F.substring(F.lower("name"), 1, 3)).distinct())
