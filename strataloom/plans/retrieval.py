"""Queries over the graph, retrieval for questions, and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import names as N
from ..functions import responses as R
from ..operators import aggregate, evaluate, graph, retrieve
from ..sources import readers, writers
from ..streaming import ingest
from .catalog import register
from .tables import EDGES, ENTITIES, MENTIONS, NODES, clean_sql, graph_edges, graph_nodes, listed, mentions, normal_sql, quoted, raw_entities, raw_relations, table

# An undirected view of the edges.
_UND = f"(SELECT edge_id, src AS node, dst AS neighbor, type FROM {EDGES} UNION ALL SELECT edge_id, dst, src, type FROM {EDGES} WHERE src <> dst)"


def _starts(spark, sf_dir, name: str, prefix: str, key: str):
    return table(spark, sf_dir, name).select(F.concat(F.lit(f"{prefix} "), F.col(key).cast("string")).alias("start"))


# Each user's events as a chain of steps; a question starts at the user's first event.
_CHAIN = """(SELECT event_id AS edge_id, 'event ' || event_id AS src, 'event ' || nxt AS dst, CASE WHEN kind = 'purchase' THEN 'altro' WHEN event_id % 2 = 0 THEN 'haPassoSuccessivo' ELSE 'includeOperazione' END AS type, user_id FROM (
  SELECT event_id, user_id, event_type AS kind, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""


@register(f"""WITH RECURSIVE e AS (SELECT * FROM {_CHAIN} WHERE lower(type) IN ('hapassosuccessivo', 'includeoperazione')), s AS (SELECT 'event ' || arg_min(event_id, (ts, event_id)) AS start FROM events GROUP BY user_id),
p AS (SELECT start, src, dst, [start, dst] AS nodes, [edge_id] AS edge_ids FROM s JOIN e ON start = src UNION ALL SELECT p.start, e.src, e.dst, list_append(nodes, e.dst), list_append(edge_ids, e.edge_id) FROM p JOIN e ON p.dst = e.src WHERE len(edge_ids) < 5 AND NOT list_contains(edge_ids, e.edge_id))
SELECT start, nodes, edge_ids, CAST(len(edge_ids) AS INTEGER) AS length FROM p QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(edge_ids) DESC, edge_ids) <= 3""")
def proc_paths(spark, sf_dir):
    starts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("e")).select(F.concat(F.lit("event "), F.col("e").cast("string")).alias("start"))
    return graph.longest(graph.trails(starts, _event_chain(spark, sf_dir), graph.PROCEDURE_STEPS))


def _event_chain(spark, sf_dir):
    chain = table(spark, sf_dir, "events").withColumn("nxt", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("nxt IS NOT NULL")
    kind = F.when(F.col("event_type") == "purchase", "altro").when(F.col("event_id") % 2 == 0, "haPassoSuccessivo").otherwise("includeOperazione")
    name = lambda c: F.concat(F.lit("event "), F.col(c).cast("string"))
    return chain.select(F.col("event_id").alias("edge_id"), name("event_id").alias("src"), name("nxt").alias("dst"), kind.alias("type"))


@register(f"""SELECT s.start, a.dst AS prerequisite, b.dst AS document FROM (SELECT name AS start FROM {NODES}) s
LEFT JOIN {EDGES} a ON a.src = s.start AND lower(a.type) = 'haprerequisito' LEFT JOIN {EDGES} b ON b.src = s.start AND lower(b.type) = 'richiededocumento'""")
def requirements_join(spark, sf_dir):
    return graph.requirements(graph_nodes(spark, sf_dir).select(F.col("name").alias("start")), graph_edges(spark, sf_dir))


def _hop_sql(start: str, limit: int) -> str:
    return f"""SELECT s.start, edge_id, neighbor, type FROM ({start}) s JOIN {_UND} u ON u.node = s.start QUALIFY row_number() OVER (PARTITION BY s.start ORDER BY type, neighbor, edge_id) <= {limit}"""


@register(_hop_sql("SELECT 'nation ' || n_nationkey AS start FROM nation", 15))
def definition_1hop(spark, sf_dir):
    return graph.one_hop(_starts(spark, sf_dir, "nation", "nation", "n_nationkey"), graph_edges(spark, sf_dir), 15)


@register(_hop_sql("SELECT 'supplier ' || s_suppkey AS start FROM supplier", 5))
def generic_1hop(spark, sf_dir):
    return graph.one_hop(_starts(spark, sf_dir, "supplier", "supplier", "s_suppkey"), graph_edges(spark, sf_dir), 5)


_LINKS = f"l AS (SELECT DISTINCT node, neighbor FROM {_UND})"


def _reached_sql(name: str, starts: str, most: int = 10) -> str:
    """Hops from every start to every node at most ``most`` away, by a search that keeps one row a node."""
    return f"""{name}(src, place, d) USING KEY (src, place) AS (SELECT src, src, 0 FROM ({starts}) UNION SELECT b.src, l.neighbor, min(b.d) + 1 FROM {name} b JOIN l ON l.node = b.place
WHERE b.d < {most} AND NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.src = b.src AND r.place = l.neighbor) GROUP BY b.src, l.neighbor)"""


_NATIONS = "SELECT 'nation ' || n_nationkey AS src, 'nation ' || ((n_nationkey * 7 + 5) % 25) AS dst FROM nation"


@register(f"""WITH RECURSIVE {_LINKS}, {_reached_sql('b', _NATIONS)} SELECT x.src, x.dst, CAST(d AS INTEGER) AS length FROM ({_NATIONS}) x JOIN b ON b.src = x.src AND b.place = x.dst""")
def shortest_path_len(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    name = lambda c: F.concat(F.lit("nation "), c.cast("string"))
    pairs = nations.select(name(F.col("n_nationkey")).alias("src"), name((F.col("n_nationkey") * 7 + 5) % 25).alias("dst"))
    return graph.shortest_lengths(pairs, graph_edges(spark, sf_dir))


_TERMS = ["Nation 1", "region", "SUPPLIER 1", "zz", "nation 24", "9"]
_TERMS_SQL = "(SELECT unnest(['Nation 1', 'region', 'SUPPLIER 1', 'zz', 'nation 24', '9']) AS term)"


@register(f"""WITH n AS (SELECT name FROM {NODES}), h AS (SELECT term, name FROM {_TERMS_SQL} JOIN n ON contains(lower(name), lower(term))), l AS (SELECT DISTINCT node, neighbor FROM {_UND})
SELECT term, name, neighbor FROM h LEFT JOIN l ON l.node = h.name QUALIFY row_number() OVER (PARTITION BY term ORDER BY name, neighbor NULLS FIRST) <= 10""")
def fallback_search(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return graph.search_or_neighbors(terms, graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


# A question's search terms: all of its long words and, as names of entities, its capitalised words.
_QTERMS = r"(SELECT item_id AS question_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(text), '\p{L}{7,}'), list_transform(regexp_extract_all(text, '\p{Lu}\p{L}{5,}'), lambda w: lower(w))))) AS term FROM benchmark)"


def _questions(spark, sf_dir):
    """Every question as its analysis gives it: (question_id, question, entities, terms, embedding); some have no vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return asked.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), found("text", r"\p{Lu}\p{L}{5,}").alias("entities"), found(F.lower("text"), r"\p{L}{7,}").alias("terms"), "embedding")


def _question_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", F.explode(N.search_terms(F.col("terms"), F.col("entities"))).alias("term"))


@register(f"SELECT * FROM {_QTERMS}")
def search_terms(spark, sf_dir):
    return _question_terms(spark, sf_dir)


_NODES_SQL = f"""k AS (SELECT *, {clean_sql('nome_entita')} AS x FROM {ENTITIES}), m AS (SELECT *, {normal_sql('x')} AS name FROM k), nodes AS (SELECT name, arg_min(source_chunk_id, ord) AS source_chunk_id, arg_min(tipo_entita, ord) AS type, arg_min(coalesce(descrizione_entita, ''), ord) AS description FROM m WHERE name <> '' GROUP BY name),
spell AS (SELECT DISTINCT name, nome_entita FROM m)"""
_ANCHORS_SQL = f"""anchors AS (SELECT DISTINCT question_id, s.name FROM {_QTERMS} t JOIN spell s ON contains(lower(s.name), t.term) OR contains(lower(s.nome_entita), t.term))"""
_LINKS_SQL = f"""links AS (SELECT ord AS edge_id, {normal_sql('sx')} AS src, {normal_sql('ox')} AS dst FROM (SELECT ord, lower(soggetto) AS sx, lower(oggetto) AS ox FROM (
  SELECT doc_id * 4294967296 + pos AS ord, name AS soggetto, lead(name) OVER (PARTITION BY doc_id ORDER BY pos) AS oggetto FROM {MENTIONS}) WHERE oggetto IS NOT NULL))"""
_FOUND_SQL = """found AS (SELECT question_id, name FROM hybrid UNION SELECT a.question_id, o.name FROM (SELECT DISTINCT question_id, source_chunk_id FROM hybrid JOIN nodes USING (name)) a JOIN nodes o ON a.source_chunk_id = o.source_chunk_id
  UNION SELECT question_id, dst FROM hybrid JOIN links ON src = name UNION SELECT question_id, src FROM hybrid JOIN links ON dst = name)"""


def _mention_graph(spark, sf_dir):
    """Nodes, which are met often and kept, and edges, which are met once."""
    nodes = cut(aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)))
    return nodes, aggregate.edges_raw(raw_relations(spark, sf_dir), nodes).select("edge_id", "src", "dst", F.col("predicate").alias("type"))


@register(f"WITH {_NODES_SQL}, {_ANCHORS_SQL} SELECT * FROM anchors")
def keyword_anchor(spark, sf_dir):
    return retrieve.keyword_anchors(_question_terms(spark, sf_dir), aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)))


_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_TOP = f"""(SELECT q.vec_id AS question_id, v.vec_id AS id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, v.vec_id) AS "rank" FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings v QUALIFY "rank" <= 20)"""


def _question_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "embedding")


@register(f'SELECT question_id, id, CAST("rank" AS INTEGER) AS "rank" FROM {_TOP}')
def vector_topk(spark, sf_dir):
    return retrieve.vector_top_k(_question_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")).select("question_id", "id", "rank")


_CHUNKS_SQL = "chunks AS (SELECT source || '_section_' || doc_id AS chunk_id, text, source AS source_file, CAST(doc_id % 7 AS INTEGER) AS page_number, lang AS section_title FROM documents)"
# The 20 chunks nearest to a question; all vectors of documents take part.
_CLOSE_SQL = f"""close AS (SELECT b.item_id AS question_id, d.source || '_section_' || d.doc_id AS chunk_id FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id CROSS JOIN embeddings v JOIN documents d ON d.doc_id = v.vec_id QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY {_COSINE} DESC, v.vec_id) <= 20)"""
_HYBRID_SQL = "hybrid AS (SELECT question_id, name FROM anchors UNION SELECT question_id, name FROM close JOIN nodes ON chunk_id = source_chunk_id)"


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.col("source").alias("source_file"), (F.col("doc_id") % 7).cast("int").alias("page_number"), F.col("lang").alias("section_title"))


def _chunk_vectors(spark, sf_dir):
    """All vectors with the chunk of the document they belong to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "chunk_id", "embedding")


@register(f"WITH {_NODES_SQL}, {_ANCHORS_SQL}, {_CLOSE_SQL}, {_HYBRID_SQL} SELECT question_id, name FROM hybrid")
def hybrid_anchor(spark, sf_dir):
    nodes = cut(aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)).select("name", "original_names", "source_chunk_id"))
    questions = _questions(spark, sf_dir)
    return retrieve.hybrid_anchors(questions, _question_terms(spark, sf_dir), nodes, close=retrieve.close_chunks(questions, _chunk_vectors(spark, sf_dir)))


@register(f"WITH {_NODES_SQL}, {_ANCHORS_SQL}, {_CLOSE_SQL}, {_HYBRID_SQL}, {_LINKS_SQL}, {_FOUND_SQL} SELECT * FROM found")
def expand_subgraph(spark, sf_dir):
    nodes, edges = _mention_graph(spark, sf_dir)
    return graph.unmarked(retrieve.find_raw(_questions(spark, sf_dir), _question_terms(spark, sf_dir), nodes, edges, chunk_vectors=_chunk_vectors(spark, sf_dir))[0])


def _distinct_words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"


_RANKED_SQL = f"""cand AS (SELECT question_id, source_chunk_id AS chunk_id FROM found JOIN nodes USING (name) UNION SELECT question_id, chunk_id FROM close),
scored AS (SELECT c.question_id, c.chunk_id, round(len(list_intersect(qw, cw)) / greatest(len(qw), 1), 6) AS score FROM cand c JOIN (SELECT chunk_id, {_distinct_words("coalesce(text, '')")} AS cw FROM chunks) k USING (chunk_id) JOIN (SELECT item_id, {_distinct_words('text')} AS qw FROM benchmark) b ON b.item_id = c.question_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS "rank" FROM scored QUALIFY "rank" <= 5)"""


_RAW_SQL = f"{_NODES_SQL}, {_ANCHORS_SQL}, {_CLOSE_SQL}, {_HYBRID_SQL}, {_LINKS_SQL}, {_FOUND_SQL}, {_CHUNKS_SQL}, {_RANKED_SQL}"


@register(f'WITH {_RAW_SQL} SELECT question_id, "rank", chunk_id, score FROM ranked')
def retrieve_raw(spark, sf_dir):
    nodes, edges = _mention_graph(spark, sf_dir)
    found = retrieve.retrieve_raw(_questions(spark, sf_dir), _question_terms(spark, sf_dir), nodes, edges, _chunks(spark, sf_dir), chunk_vectors=_chunk_vectors(spark, sf_dir))
    return found.select("question_id", "rank", "chunk_id", "score")


@register(f"""WITH {_NODES_SQL}, {_ANCHORS_SQL}, {_CHUNKS_SQL} SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY coalesce(page_number, 0), chunk_id) AS INTEGER) AS "rank" FROM (SELECT DISTINCT question_id, source_chunk_id AS chunk_id FROM anchors JOIN nodes USING (name)) JOIN chunks USING (chunk_id)""")
def retrieve_aggregated(spark, sf_dir):
    nodes = cut(aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)).select("name", "original_names", "source_chunk_id"))
    found = retrieve.keyword_anchors(_question_terms(spark, sf_dir), nodes)
    sources = nodes.select("name", F.array("source_chunk_id").alias("source_chunk_ids"))
    return retrieve.retrieve_aggregated(found, sources, _chunks(spark, sf_dir)).select("question_id", "chunk_id", "rank")


@register(f"""WITH {_CHUNKS_SQL}, s AS (SELECT item_id AS question_id, chunk_id, round(len(list_intersect(qw, cw)) / greatest(len(qw), 1), 6) AS score FROM (SELECT item_id, {_distinct_words('text')} AS qw FROM benchmark) b JOIN (SELECT chunk_id, {_distinct_words("coalesce(text, '')")} AS cw FROM chunks) c ON true)
SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS "rank" FROM s QUALIFY "rank" <= 5""")
def rerank_top5(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return retrieve.rerank_all(questions, _chunks(spark, sf_dir)).select("question_id", "chunk_id", "rank")


@register(f"SELECT doc_id, name FROM {MENTIONS} QUALIFY row_number() OVER (PARTITION BY name, lang ORDER BY doc_id, pos) = 1")
def dedupe_first_seen(spark, sf_dir):
    rows = mentions(spark, sf_dir).withColumn("o", F.struct("doc_id", "pos"))
    return retrieve.first_seen(rows, ["name", "lang"], "o").select("doc_id", "name")


_SPELLINGS_SQL = "v AS (SELECT name, list(nome_entita ORDER BY f) AS vs FROM (SELECT name, nome_entita, min(ord) AS f FROM m GROUP BY 1, 2) GROUP BY name)"


def _context_sql(found: str) -> str:
    """(question_id, graph_context) of the nodes of a table (question_id, name)."""
    return f"""(SELECT question_id, 'Informazioni rilevanti trovate nel Knowledge Graph:' || chr(10) || chr(10) || string_agg('✓ **Entità trovata**: ' || name || chr(10) || '  • Tipo: ' || type || CASE WHEN description <> '' THEN chr(10) || '  • Descrizione: ' || description ELSE '' END
|| chr(10) || '  • Varianti trovate: ' || array_to_string(vs[1:3], ', ') || CASE WHEN len(vs) > 3 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY name) AS graph_context FROM {found} JOIN nodes USING (name) JOIN v USING (name) GROUP BY question_id)"""


@register(f"WITH {_NODES_SQL}, {_ANCHORS_SQL}, {_SPELLINGS_SQL} SELECT * FROM {_context_sql('anchors')}")
def context_render(spark, sf_dir):
    nodes = cut(aggregate.merge_nodes_raw(raw_entities(spark, sf_dir)))
    return retrieve.graph_context(retrieve.keyword_anchors(_question_terms(spark, sf_dir), nodes).join(nodes, "name"))


def _texts_sql(ranked: str) -> str:
    """(question_id, text_context) of a table (question_id, rank, chunk_id) with its chunks."""
    return f"""(SELECT question_id, '--- Testo Originale dalle Guide per Contesto Aggiuntivo ---' || chr(10) || chr(10) || string_agg('Fonte: ' || source_file || ' - Pagina ' || chunks.page_number || ' - Sezione ' || chr(39) || coalesce(section_title, 'N/A') || chr(39) || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```', chr(10) || chr(10) ORDER BY "rank") AS text_context
FROM {ranked} JOIN chunks USING (chunk_id) GROUP BY question_id)"""


def _answers_sql(graphs: str, texts: str) -> str:
    """Questions with the offline answer and the contexts it had."""
    head, graph, text, tail = R.PROMPTS["answer"].split("%s")
    asked = f"len({quoted(head)} || question || {quoted(graph)} || g || {quoted(text)} || t || {quoted(tail)})"
    return f"""SELECT question_id, question, CASE WHEN NOT ((g = '' OR contains(g, 'Nessuna')) AND (t = '' OR contains(t, 'Nessun'))) THEN 'Contesto di ' || {asked} || ' caratteri.' ELSE {quoted(R.NO_ANSWER)} END AS answer,
list_filter([CASE WHEN g <> '' AND NOT contains(g, 'Nessuna') THEN g END, CASE WHEN t <> '' AND NOT contains(t, 'Nessun') THEN t END], lambda x: x IS NOT NULL) AS contexts
FROM (SELECT item_id AS question_id, text AS question, coalesce(graph_context, {quoted(R.NO_GRAPH)}) AS g, coalesce(text_context, '') AS t FROM benchmark LEFT JOIN {graphs} gs ON gs.question_id = item_id LEFT JOIN {texts} ts ON ts.question_id = item_id)"""


@register(f"WITH {_RAW_SQL}, {_SPELLINGS_SQL} {_answers_sql(_context_sql('found'), _texts_sql('ranked'))}")
def qa_batch(spark, sf_dir):
    nodes, edges = _mention_graph(spark, sf_dir)
    return retrieve.ask(_questions(spark, sf_dir), nodes, edges, _chunks(spark, sf_dir), "raw", chunk_vectors=_chunk_vectors(spark, sf_dir))


# Questions of every intent over the whole typed graph, to which the users' events belong as actions; the number in a node's name is the document it comes from.
_ALL_NODES = f"(SELECT name, type, label FROM {NODES} UNION ALL SELECT 'event ' || event_id, 'AzioneUtente', event_type FROM events)"
_ALL_EDGES = f"(SELECT edge_id, src, dst, type FROM {EDGES} UNION ALL SELECT 20000000000 + edge_id, src, dst, type FROM {_CHAIN})"
_ALL_UND = f"(SELECT edge_id, src AS node, dst AS neighbor, type FROM {_ALL_EDGES} UNION ALL SELECT edge_id, dst, src, type FROM {_ALL_EDGES} WHERE src <> dst)"
_INTENTS = ["find_procedure", "find_requirements", "find_definition", "find_relationship", "generic_search", "find_definition"]
_ENTITIES = [
    "['event ' || item_id, 'event ' || (item_id + 1)]", "['customer ' || item_id, 'order ' || item_id, 'part ' || (item_id + 1)]", "['nation ' || (item_id % 25)]",
    "['supplier ' || (item_id % 10 + 1), 'customer ' || (item_id + 1)]", "['supplier ' || (item_id % 10 + 1)]", "['Nation ' || (item_id % 25), '']",
]
_INTENT_QUESTIONS = f"q AS (SELECT item_id AS question_id, {listed(_INTENTS)}[item_id % 6 + 1] AS intent, CASE item_id % 6 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_ENTITIES))} END AS names FROM benchmark)"
_TWO = "SELECT question_id, names[1] AS src, names[2] AS dst FROM q WHERE intent = 'find_relationship'"
_INTENT_SQL = f"""{_INTENT_QUESTIONS}, n AS (SELECT * FROM {_ALL_NODES}), e AS (SELECT * FROM {_ALL_EDGES}), und AS (SELECT * FROM {_ALL_UND}), l AS (SELECT DISTINCT node, neighbor FROM und),
st AS (SELECT DISTINCT question_id, name AS start FROM (SELECT question_id, unnest(names) AS name FROM q WHERE intent = 'find_procedure') JOIN n USING (name) WHERE type IN ('AzioneUtente', 'FunzionalitàPiattaforma', 'PiattaformaModulo')),
steps AS (SELECT * FROM e WHERE lower(type) IN ('hapassosuccessivo', 'includeoperazione')),
p AS (SELECT question_id, dst AS place, [start, dst] AS nodes, [edge_id] AS ids FROM st JOIN steps ON src = start UNION ALL SELECT question_id, dst, list_append(nodes, dst), list_append(ids, edge_id) FROM p JOIN steps ON src = place WHERE len(ids) < 5 AND NOT list_contains(ids, edge_id)),
f1 AS (SELECT question_id, unnest(nodes) AS name FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY len(ids) DESC, ids) <= 3)),
r AS (SELECT question_id, name AS start, a.dst AS pre, b.dst AS doc FROM (SELECT DISTINCT question_id, unnest(names) AS name FROM q WHERE intent = 'find_requirements') JOIN n USING (name) LEFT JOIN e a ON a.src = name AND lower(a.type) = 'haprerequisito' LEFT JOIN e b ON b.src = name AND lower(b.type) = 'richiededocumento'),
f2 AS (SELECT question_id, unnest(CASE WHEN pre IS NOT NULL OR doc IS NOT NULL THEN [start, pre, doc] ELSE [NULL] END) AS name FROM r),
f3 AS (SELECT question_id, unnest([node, neighbor]) AS name FROM (SELECT question_id, node, neighbor FROM q JOIN und ON node = names[1] WHERE intent IN ('find_definition', 'generic_search') QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY und.type, neighbor, edge_id) <= CASE intent WHEN 'find_definition' THEN 15 ELSE 5 END)),
{_reached_sql('ds', f'SELECT DISTINCT src FROM ({_TWO})')}, {_reached_sql('dd', f'SELECT DISTINCT dst AS src FROM ({_TWO})')},
w AS (SELECT question_id, t.src, dst, d FROM ({_TWO}) t JOIN ds ON ds.src = t.src AND ds.place = t.dst WHERE t.src <> t.dst),
g AS (SELECT question_id, src AS name, 0 AS k FROM w UNION ALL SELECT g.question_id, min(l.neighbor), g.k + 1 FROM g JOIN w ON w.question_id = g.question_id JOIN l ON l.node = g.name JOIN dd ON dd.src = w.dst AND dd.place = l.neighbor AND dd.d = w.d - g.k - 1 WHERE g.k < w.d GROUP BY g.question_id, g.k),
f AS (SELECT * FROM f1 UNION SELECT * FROM f2 UNION SELECT * FROM f3 UNION SELECT question_id, name FROM g),
m AS (SELECT q.question_id, names[1] AS term FROM q WHERE question_id NOT IN (SELECT question_id FROM f)),
h AS (SELECT question_id, n.name, l.neighbor FROM m JOIN n ON contains(lower(n.name), lower(term)) LEFT JOIN l ON l.node = n.name QUALIFY row_number() OVER (PARTITION BY term, question_id ORDER BY n.name, neighbor NULLS FIRST) <= 10),
found AS (SELECT DISTINCT question_id, name FROM (SELECT * FROM f UNION ALL SELECT question_id, unnest([name, neighbor]) FROM h) WHERE name IS NOT NULL)"""


def _all_graph(spark, sf_dir):
    """Nodes (name, type, descriptions, source_chunk_ids) and edges of the typed graph with the users' events."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"), F.lit("AzioneUtente").alias("type"), F.col("event_type").alias("label"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    nodes = graph_nodes(spark, sf_dir).union(events).join(docs, F.split_part("name", F.lit(" "), F.lit(2)).cast("long") == F.col("_d"), "left")
    nodes = nodes.select("name", "type", F.array("label").alias("descriptions"), F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")).alias("source_chunk_ids"))
    chain = _event_chain(spark, sf_dir).withColumn("edge_id", F.lit(20000000000) + F.col("edge_id"))
    return cut(nodes), cut(graph_edges(spark, sf_dir).unionByName(chain))  # a graph is loaded once and queried many times


def _intent_questions(spark, sf_dir):
    k, name = F.col("item_id"), lambda kind, n: F.concat(F.lit(f"{kind} "), n.cast("string"))
    entities = [
        [name("event", k), name("event", k + 1)], [name("customer", k), name("order", k), name("part", k + 1)], [name("nation", k % 25)],
        [name("supplier", k % 10 + 1), name("customer", k + 1)], [name("supplier", k % 10 + 1)], [name("Nation", k % 25), F.lit("")],
    ]
    intent, names = F.lit(None), F.lit(None)
    for i in range(5, -1, -1):
        intent, names = F.when(k % 6 == i, _INTENTS[i]).otherwise(intent), F.when(k % 6 == i, F.array(*entities[i])).otherwise(names)
    return table(spark, sf_dir, "benchmark").select(k.alias("question_id"), F.col("text").alias("question"), intent.alias("intent"), names.alias("entities"))


@register(f"WITH RECURSIVE {_INTENT_SQL} SELECT question_id, name FROM found")
def retrieve_by_intent(spark, sf_dir):
    nodes, edges = _all_graph(spark, sf_dir)
    return graph.find_by_intent(_intent_questions(spark, sf_dir), nodes, edges)


_DESCRIBED_SQL = """(SELECT question_id, 'Informazioni rilevanti trovate nel Knowledge Graph:' || chr(10) || chr(10) || string_agg('- Entità: ' || name || ' (Tipo: ' || type || ')' || chr(10) || '  Descrizione: ' || label, chr(10) ORDER BY name) AS graph_context FROM found JOIN n USING (name) GROUP BY question_id)"""
_PAGED_SQL = """ranked AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(page_number, 0), chunk_id) AS "rank" FROM (SELECT DISTINCT question_id, chunk_id, page_number FROM found JOIN chunks ON TRY_CAST(split_part(name, ' ', 2) AS BIGINT) = doc_id))"""


@register(f"WITH RECURSIVE {_INTENT_SQL}, {_CHUNKS_SQL.replace('FROM documents', ', doc_id FROM documents')}, {_PAGED_SQL} {_answers_sql(_DESCRIBED_SQL, _texts_sql('ranked'))}")
def qa_aggregated(spark, sf_dir):
    nodes, edges = _all_graph(spark, sf_dir)
    return retrieve.ask(_intent_questions(spark, sf_dir), nodes, edges, _chunks(spark, sf_dir), "aggregated")


# Documents with labels play an evaluation run: quality and toxic as metrics, the language as a question's type.
_RESULTS = "(SELECT 'q' || doc_id AS user_input, CASE WHEN doc_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE quality + doc_id % 10 / 10.0 END AS faithfulness, CAST(toxic AS DOUBLE) AS answer_relevancy, quality * 0.5 AS context_precision, CASE WHEN doc_id % 3 > 0 THEN 1.0 / (1 + doc_id % 4) END AS context_recall FROM labels)"
_GOLDEN = "(SELECT 'q' || doc_id AS question, lang AS question_type, CASE WHEN n_chars > 1000 THEN 'Difficile' ELSE 'Facile' END AS difficulty FROM documents WHERE doc_id % 5 > 0)"
_META = f"(SELECT r.*, coalesce(g.question_type, 'Unknown') AS question_type, coalesce(g.difficulty, 'Unknown') AS difficulty FROM {_RESULTS} r LEFT JOIN {_GOLDEN} g ON r.user_input = g.question)"


def _results(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("q"), n.cast("string")).alias("user_input"), F.when(n % 11 == 0, F.lit(float("nan"))).otherwise(F.col("quality") + n % 10 / F.lit(10.0)).alias("faithfulness"), F.col("toxic").cast("double").alias("answer_relevancy"),
        (F.col("quality") * 0.5).alias("context_precision"), F.when(n % 3 > 0, 1.0 / (1 + n % 4)).alias("context_recall"),
    )
    golden = table(spark, sf_dir, "documents").where("doc_id % 5 > 0").select(n.alias("ord"), F.concat(F.lit("q"), n.cast("string")).alias("question"), F.col("lang").alias("question_type"), F.when(F.col("n_chars") > 1000, "Difficile").otherwise("Facile").alias("difficulty"))
    return evaluate.with_metadata(rows, golden)


@register(f"SELECT user_input, question_type, difficulty FROM {_META}")
def eval_join_unknown(spark, sf_dir):
    return _results(spark, sf_dir).select("user_input", "question_type", "difficulty")


_MEANS = ", ".join(f"round(avg(CASE WHEN isnan({m}) THEN NULL ELSE {m} END), 6) AS {m}" for m in ("faithfulness", "answer_relevancy", "context_precision", "context_recall"))


@register(f"""SELECT 'all' AS "grouping", '' AS value, count(*) AS n, {_MEANS} FROM {_META} UNION ALL SELECT 'question_type', question_type, count(*), {_MEANS} FROM {_META} GROUP BY question_type UNION ALL SELECT 'difficulty', difficulty, count(*), {_MEANS} FROM {_META} GROUP BY difficulty""")
def eval_group_means(spark, sf_dir):
    return evaluate.grouped_means(_results(spark, sf_dir))


@register(f"""(SELECT 'best' AS which, user_input, faithfulness AS score FROM {_RESULTS} WHERE NOT isnan(faithfulness) ORDER BY faithfulness DESC, user_input DESC LIMIT 1) UNION ALL (SELECT 'worst', user_input, faithfulness FROM {_RESULTS} WHERE NOT isnan(faithfulness) ORDER BY faithfulness, user_input LIMIT 1)""")
def eval_best_worst(spark, sf_dir):
    return evaluate.best_and_worst(_results(spark, sf_dir))


@register(f"""WITH got AS (SELECT question_id, CAST(id AS VARCHAR) AS chunk_id FROM {_TOP} WHERE "rank" <= 5), need AS (SELECT DISTINCT b.item_id AS question_id, CAST(v.vec_id AS VARCHAR) AS chunk_id FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings v ON v.label = q.label),
s AS (SELECT coalesce(n.question_id, g.question_id) AS question_id, n.chunk_id AS n, g.chunk_id AS g FROM need n FULL JOIN got g ON n.question_id = g.question_id AND n.chunk_id = g.chunk_id)
SELECT question_id, count(n) AS n_required, count(g) AS n_retrieved, CAST(count(*) FILTER (WHERE n IS NOT NULL AND g IS NOT NULL) AS BIGINT) AS n_hit, round(count(*) FILTER (WHERE n IS NOT NULL AND g IS NOT NULL) / nullif(count(n), 0), 6) AS recall, round(count(*) FILTER (WHERE n IS NOT NULL AND g IS NOT NULL) / nullif(count(g), 0), 6) AS precision FROM s GROUP BY question_id""")
def retrieval_recall_precision(spark, sf_dir):
    got = vector_topk(spark, sf_dir).where(F.col("rank") <= 5).select("question_id", F.col("id").cast("string").alias("chunk_id"))
    vectors = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), "label")
    need = asked.join(vectors.select("label", F.col("vec_id").cast("string").alias("chunk_id")), "label").select("question_id", "chunk_id")
    return evaluate.retrieval_scores(got, need)


@register("SELECT chunk_id FROM (SELECT source || '_section_' || doc_id AS chunk_id, text, doc_id FROM documents) WHERE len(trim(coalesce(text, ''))) > 0 AND doc_id % 3 > 0")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat("source", F.lit("_section_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return ingest.remaining(_chunks(spark, sf_dir), done).select("chunk_id")


@register("SELECT doc_id AS name FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE embedding IS NULL AND doc_id IS NOT NULL")
def pending_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), "embedding")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.lit(None).cast("array<float>").alias("embedding"))
    return readers.missing_embeddings(writers.put_embeddings(nodes, vectors)).select("name")


@register("SELECT doc_id AS name, CASE WHEN vec_id IS NOT NULL THEN round(CAST(embedding[1] AS DOUBLE), 6) ELSE 0.5 END AS first FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_upsert(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), "embedding")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.array(F.lit(0.5).cast("float")).alias("embedding"))
    return writers.put_embeddings(nodes, vectors).select("name", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def append_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even, odd = docs.where("doc_id % 2 = 0").select("lang"), docs.where("doc_id % 2 = 1").select("lang")
    return even.unionByName(odd).unionByName(even).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register(f"""SELECT doc_id, {normal_sql('x')} AS canonical FROM (SELECT doc_id, {clean_sql('source')} AS x FROM documents)""")
def source_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.normalize_entity_name(F.col("source")).alias("canonical"))
