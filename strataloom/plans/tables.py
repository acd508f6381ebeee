"""What the catalogue's queries start from: the given tables in the roles of pages, mentions, relations and a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed

#: Names with every case the rules tell apart.
SAMPLE_NAMES = ["Parola d'accesso", "Password di rete", "  Albo Fornitori ", "criterio", "Documento Unico Europeo", "Il Responsabile del Procedimento", "d", "", "   ", "Registrazione Albo", "Impresa–Ditta", "Log In", "il la", "Elenco`ditte", "RUP"]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(xs: list[str], column: str) -> str:
    return f"(SELECT unnest([{', '.join(map(quoted, xs))}]) AS {column})"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(spark: SparkSession, xs: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in xs], f"{column} string")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normal_sql(x: str) -> str:
    """The canonical name of ``x``, which is lower-cased and cleaned."""
    exact = "".join(f" WHEN {x} = {quoted(k)} THEN {quoted(v)}" for k, v in fixed.NAME_RULES.items())
    inside = "".join(f" WHEN contains({x}, {quoted(k)}) THEN {quoted(v)}" for k, v in fixed.NAME_RULES.items())
    left = f"array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: len(w) > 1 AND NOT list_contains({listed(fixed.STOP_WORDS)}, w)), ' ')"
    return f"CASE WHEN {x} = '' THEN ''{exact}{inside} ELSE coalesce(nullif({left}, ''), {x}) END"


def clean_sql(x: str) -> str:
    return f"translate(lower({strip_sql(x)}), '`–—', '''--')"


def keyword_sql(x: str, table_: dict, otherwise: str) -> str:
    tests = "".join(" WHEN " + " OR ".join(f"contains({x}, {quoted(k)})" for k in keys) + f" THEN {quoted(v)}" for v, keys in table_.items())
    return f"CASE{tests} ELSE {otherwise} END"


# Lines of documents: (doc_id, source, ln, line).
LINES = """(SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS ln, l[i] AS line FROM (
  SELECT doc_id, source, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ln", "line"))


# Documents as the pages of files: up to 64 documents of a source are one file.
FILE = "(source || '_' || (doc_id // 64))"


def file_of() -> Column:
    return F.concat(F.col("source"), F.lit("_"), F.floor(F.col("doc_id") / 64).cast("string"))


# Long words as mentions of entities: (doc_id, source, lang, pos, name).
MENTIONS = r"""(SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS pos, t[i] AS name FROM (
  SELECT doc_id, source, lang, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '\p{L}{6,}') AS t FROM documents)))"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{6,}"), F.lit(0))).alias("pos", "name"))


ENTITIES = f"""(SELECT doc_id * 4294967296 + pos AS ord, name AS nome_entita, CASE (pos + len(name)) % 3 WHEN 0 THEN 'AzioneUtente' WHEN 1 THEN 'DocumentoSistema' ELSE 'RuoloUtente' END AS tipo_entita,
  CASE WHEN pos % 4 > 0 THEN 'descrizione ' || (pos % 4) END AS descrizione_entita, source || '_section_' || doc_id AS source_chunk_id, CAST(doc_id % 7 AS INTEGER) AS source_page_number, lang AS source_section_title FROM {MENTIONS})"""


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("pos") + F.length("name")) % 3
    return mentions(spark, sf_dir).select(
        (F.col("doc_id") * 4294967296 + F.col("pos")).alias("ord"), F.col("name").alias("nome_entita"), F.when(kind == 0, "AzioneUtente").when(kind == 1, "DocumentoSistema").otherwise("RuoloUtente").alias("tipo_entita"),
        F.when(F.col("pos") % 4 > 0, F.concat(F.lit("descrizione "), (F.col("pos") % 4).cast("string"))).alias("descrizione_entita"), F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("source_chunk_id"),
        (F.col("doc_id") % 7).cast("int").alias("source_page_number"), F.col("lang").alias("source_section_title"),
    )


RELATIONS = f"""(SELECT ord, soggetto, CASE pos % 4 WHEN 0 THEN 'ha Passo Successivo' WHEN 1 THEN 'includeOperazione' WHEN 2 THEN 'haPrerequisito' ELSE 'è Eseguita Da' END AS predicato, oggetto,
  CASE WHEN pos % 3 > 0 THEN 'contesto ' || (pos % 3) END AS contesto_relazione, source_chunk_id, source_page_number, source_section_title FROM (
  SELECT doc_id * 4294967296 + pos AS ord, pos, name AS soggetto, lead(name) OVER (PARTITION BY doc_id ORDER BY pos) AS oggetto, source || '_section_' || doc_id AS source_chunk_id, CAST(doc_id % 7 AS INTEGER) AS source_page_number, lang AS source_section_title FROM {MENTIONS}) WHERE oggetto IS NOT NULL)"""


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention with the next one of its document; a document's words are one array, so no window is needed."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{6,}"), F.lit(0)))
    pairs = docs.select("doc_id", "source", "lang", F.posexplode(F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "x"))
    step = F.col("pos") % 4
    return pairs.select(
        (F.col("doc_id") * 4294967296 + F.col("pos")).alias("ord"), F.col("x.a").alias("soggetto"), F.when(step == 0, "ha Passo Successivo").when(step == 1, "includeOperazione").when(step == 2, "haPrerequisito").otherwise("è Eseguita Da").alias("predicato"), F.col("x.b").alias("oggetto"),
        F.when(F.col("pos") % 3 > 0, F.concat(F.lit("contesto "), (F.col("pos") % 3).cast("string"))).alias("contesto_relazione"), F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("source_chunk_id"),
        (F.col("doc_id") % 7).cast("int").alias("source_page_number"), F.col("lang").alias("source_section_title"),
    )


# A typed graph from the key columns of the tables.
NODES = """(SELECT 'region ' || r_regionkey AS name, 'Organismo' AS type, r_name AS label FROM region UNION ALL SELECT 'nation ' || n_nationkey, 'EnteEsterno', n_name FROM nation
  UNION ALL SELECT 'customer ' || c_custkey, 'RuoloUtente', c_name FROM customer UNION ALL SELECT 'supplier ' || s_suppkey, 'RuoloUtente', s_name FROM supplier
  UNION ALL SELECT 'part ' || p_partkey, 'DocumentoSistema', p_name FROM part UNION ALL SELECT 'order ' || o_orderkey, 'AzioneUtente', o_orderpriority FROM orders)"""
EDGES = """(SELECT CAST(n_nationkey AS BIGINT) AS edge_id, 'nation ' || n_nationkey AS src, 'region ' || n_regionkey AS dst, 'in_region' AS type FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, 'customer ' || c_custkey, 'nation ' || c_nationkey, 'haPrerequisito' FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 'supplier ' || s_suppkey, 'nation ' || s_nationkey, 'haPrerequisito' FROM supplier
  UNION ALL SELECT 3000000000 + o_orderkey, 'order ' || o_orderkey, 'customer ' || o_custkey, 'richiedeDocumento' FROM orders
  UNION ALL SELECT 4000000000 + l_orderkey * 10 + l_linenumber, 'order ' || l_orderkey, 'part ' || l_partkey, 'contieneElemento' FROM lineitem
  UNION ALL SELECT 9000000000 + l_orderkey * 10 + l_linenumber, 'part ' || l_partkey, 'supplier ' || l_suppkey, 'richiedeDocumento' FROM lineitem)"""


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix} "), F.col(column).cast("string"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, kind, prefix, key, label in (("region", "Organismo", "region", "r_regionkey", "r_name"), ("nation", "EnteEsterno", "nation", "n_nationkey", "n_name"), ("customer", "RuoloUtente", "customer", "c_custkey", "c_name"), ("supplier", "RuoloUtente", "supplier", "s_suppkey", "s_name"), ("part", "DocumentoSistema", "part", "p_partkey", "p_name"), ("orders", "AzioneUtente", "order", "o_orderkey", "o_orderpriority")):
        one = table(spark, sf_dir, name).select(_id(prefix, key).alias("name"), F.lit(kind).alias("type"), F.col(label).alias("label"))
        out = one if out is None else out.union(one)
    return out


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parts = [
        (t("nation"), F.col("n_nationkey").cast("long"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "in_region"),
        (t("customer"), F.lit(1000000000) + F.col("c_custkey"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "haPrerequisito"),
        (t("supplier"), F.lit(2000000000) + F.col("s_suppkey"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "haPrerequisito"),
        (t("orders"), F.lit(3000000000) + F.col("o_orderkey"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "richiedeDocumento"),
        (t("lineitem"), F.lit(4000000000) + line, _id("order", "l_orderkey"), _id("part", "l_partkey"), "contieneElemento"),
        (t("lineitem"), F.lit(9000000000) + line, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "richiedeDocumento"),
    ]
    out = None
    for rows, edge, src, dst, kind in parts:
        one = rows.select(edge.alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
        out = one if out is None else out.union(one)
    return out
