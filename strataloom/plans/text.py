"""Queries over names, lines, texts and model responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import lines as L
from ..functions import names as N
from ..functions import responses as R
from ..operators import aggregate
from ..sources import readers
from .catalog import register
from .tables import FILE, LINES, MENTIONS, SAMPLE_NAMES, clean_sql, file_of, keyword_sql, lines, listed, mentions, normal_sql, quoted, sample, strip_sql, table, values


@register(f"""WITH n AS (SELECT DISTINCT name FROM {MENTIONS} UNION SELECT name FROM {values(SAMPLE_NAMES, 'name')}), c AS (SELECT name, {clean_sql('name')} AS x FROM n)
SELECT name, {normal_sql('x')} AS normalized FROM c""")
def normalize_names(spark, sf_dir):
    names = mentions(spark, sf_dir).select("name").union(sample(spark, SAMPLE_NAMES, "name")).distinct()
    return names.select("name", N.normalize_entity_name(F.col("name")).alias("normalized"))


@register(f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: len(w) > 2 AND NOT list_contains({listed(fixed.STOP_WORDS)}, w)) AS ws FROM conversations),
n AS (SELECT conv_id, turn, list_filter(list_transform(ws, lambda w: {normal_sql("translate(w, '`–—', '''--')")}), lambda w: w <> '') AS ks FROM w)
SELECT conv_id, turn, coalesce(list_filter(ks, lambda k, i: list_position(ks, k) = i), []) AS keywords FROM n""")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.keywords(F.col("text")).alias("keywords"))


_RULES = "[" + ", ".join(f"{{'k': {quoted(k)}, 'v': {quoted(v)}}}" for k, v in fixed.NAME_RULES.items()) + "]"


@register(f"""WITH n AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT name FROM {values(SAMPLE_NAMES, 'name')}), c AS (SELECT name, {clean_sql('name')} AS x FROM n), d AS (SELECT name, {normal_sql('x')} AS y FROM c),
p AS (SELECT name, list_filter(list_concat([lower(name), y], list_transform(list_filter({_RULES}, lambda r: r.v = y), lambda r: r.k), list_filter(string_split_regex(y, '\\s+'), lambda w: len(w) > 2)), lambda q: q <> '') AS ps FROM d)
SELECT name, list_filter(ps, lambda q, i: list_position(ps, q) = i) AS patterns FROM p""")
def search_patterns(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(sample(spark, SAMPLE_NAMES, "name")).distinct()
    return names.select("name", N.search_patterns(F.col("name")).alias("patterns"))


_SINGLE_SPACES = "regexp_replace(lower(text), '\\s+', ' ', 'g')"


@register(f"SELECT doc_id, {strip_sql(_SINGLE_SPACES)} AS name FROM documents")
def ws_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.collapse_name(F.col("text")).alias("name"))


_PREDICATES = ["ha Passo Successivo", "è Eseguita Da", "può avere l'esito", "Può Eseguire", "È", "É parte", "già fatta così più", "necessita di", "crea un file", "usa", "esegue", "contiene campi", "riguarda", "si serve di"]


@register(f"""SELECT predicate, translate(replace(replace(predicate, ' ', '_'), '''', ''), 'àèìòùÉ', 'aeiouE') AS safe, {keyword_sql('lower(predicate)', fixed.PREDICATE_KEYWORDS, 'predicate')} AS kind,
{keyword_sql('lower(predicate)', {v: [k] for k, v in fixed.CLOSEST_PREDICATES.items()}, quoted(fixed.DEFAULT_PREDICATE))} AS closest FROM (SELECT DISTINCT event_type AS predicate FROM events UNION SELECT predicate FROM {values(_PREDICATES, 'predicate')})""")
def predicate_forms(spark, sf_dir):
    p = F.col("predicate")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("predicate")).union(sample(spark, _PREDICATES, "predicate")).distinct()
    return rows.select("predicate", N.safe_predicate(p).alias("safe"), N.infer_relation_type(p).alias("kind"), N.closest_predicate(p).alias("closest"))


@register(f"SELECT name, {keyword_sql('lower(name)', fixed.TYPE_KEYWORDS, quoted('Unknown'))} AS type FROM (SELECT DISTINCT name FROM {MENTIONS} UNION SELECT name FROM {values(SAMPLE_NAMES, 'name')})")
def infer_entity_type(spark, sf_dir):
    names = mentions(spark, sf_dir).select("name").union(sample(spark, SAMPLE_NAMES, "name")).distinct()
    return names.select("name", N.infer_entity_type(F.col("name")).alias("type"))


@register(f"SELECT doc_id, coalesce(nullif({strip_sql('lang')}, ''), 'SezioneSconosciuta_' || string_split(source || '_' || doc_id, '_')[-1]) AS section FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS lang FROM documents)")
def section_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")))
    return docs.select("doc_id", N.section_name(F.col("lang"), F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("section"))


def _any(x: str, patterns: list[str], fold: bool = True) -> str:
    return f"regexp_matches({x}, {quoted(('(?i)' if fold else '') + '|'.join(f'(?:{p})' for p in patterns))})"


_CAPTION = _any("line", [*fixed.FIGURE_CAPTION, *fixed.TABLE_CAPTION])
_HEADER = f"({_any('line', fixed.HEADER_FOOTER)} OR len({strip_sql('line')}) < 5)"
_PAGE_REF = _any("line", fixed.PAGE_REFERENCE, False)
_LIST = _any("line", fixed.LIST_ITEM, False)
_WORDS = "list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')"
_TITLE = f"""(NOT {_CAPTION} AND ({_any('line', fixed.TITLE_WORDS)} OR (len({_WORDS}) > 1 AND len(list_filter({_WORDS}[1:3], lambda w: NOT (upper(w[1]) = w[1] AND lower(w[1]) <> w[1]))) = 0 AND NOT {_any('upper(line)', fixed.CAPTION_WORDS, False)})))"""
_SECTION = f"""(NOT {_CAPTION} AND NOT {_PAGE_REF} AND (regexp_matches(line, {quoted(fixed.NUMBERED_TITLE)}) OR (upper(line) = line AND lower(line) <> line AND len({_WORDS}) > 1 AND len(line) < 100) OR ((8 + len(line) % 8 > 12 OR ln % 5 = 0) AND {_TITLE})))"""
_SAMPLE_LINES = ["FIGURA 3 - Accesso", "Tabella riepilogativa dei campi", "Pag. 4", "QUESTO DOCUMENTO È DI PROPRIETÀ", "1. Primo passo", "• voce", "- trattino", "LISTA ATTIVITÀ BLOCCANTI", "Questo È Un Titolo", "3.2 Accesso al sistema", "12", "Introduzione al portale", "Una riga normale di testo.", "Fig. 2 schermata", "a) opzione"]


@register(f"""WITH l AS (SELECT doc_id, ln, {strip_sql('line')} AS line FROM {LINES}), k AS (
  SELECT doc_id, ln, regexp_replace(regexp_replace(line, '^Vers\\.\\s*\\d+\\.\\d+\\s*', ''), 'Pag\\.\\s*\\d+\\s*', '', 'g') AS line FROM l WHERE line <> '' AND NOT {_HEADER} AND NOT {_CAPTION} AND NOT {_PAGE_REF}),
j AS (SELECT doc_id, regexp_replace(string_agg(line, ' ' ORDER BY ln), '\\s+', ' ', 'g') AS t FROM k WHERE len(line) > 10 GROUP BY doc_id)
SELECT d.doc_id, coalesce({strip_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '(\\d+)([A-Za-z])', '\\1 \\2', 'g'), '\\s+[.]+\\s+', ' ', 'g'), '\\s+[-]+\\s+', ' ', 'g')")}, '') AS text FROM documents d LEFT JOIN j USING (doc_id)""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.clean_text(F.col("text")).alias("text"))


_TOC = ["1. INTRODUZIONE ........ 3", "2.1 ACCESSO AL SISTEMA .... 5", "GESTIONE UTENTI ..... 7", "4. LEGENDA", "Sommario", "xx", "5. PRIMO ACCESSO", "2.1 ACCESSO NUOVO .... 9", "FIGURA 1 ..... 4", "TITOLO SENZA NUMERO", "6.2.1. REGISTRAZIONE DITTE .......... 12", "PROFILAZIONE .... 14"]
_P1, _P2, _P3 = fixed.TOC_NUMBER_TITLE_PAGE, fixed.TOC_TITLE_PAGE, fixed.TOC_NUMBER_TITLE


@register(f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS file, ln AS ord, {strip_sql('line')} AS line FROM {LINES} UNION ALL SELECT 'toc', CAST(i AS INTEGER), s[i] FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM (SELECT {listed(_TOC)} AS s))),
f AS (SELECT *, CASE WHEN regexp_matches(line, {quoted(_P1)}) THEN 1 WHEN regexp_matches(line, {quoted(_P2)}) THEN 2 WHEN regexp_matches(line, {quoted(_P3)}) THEN 3 END AS shape FROM l WHERE len(line) >= 5 AND NOT {' AND NOT '.join(f"contains(lower(line), {quoted(w)})" for w in fixed.TOC_SKIP)}),
g AS (SELECT file, ord, regexp_replace(regexp_replace({strip_sql(f"CASE shape WHEN 1 THEN regexp_extract(line, {quoted(_P1)}, 2) WHEN 2 THEN regexp_extract(line, {quoted(_P2)}, 1) ELSE regexp_extract(line, {quoted(_P3)}, 2) END")}, '\\s+', ' ', 'g'), '[.]+$', '') AS title,
  TRY_CAST(CASE shape WHEN 1 THEN regexp_extract(line, {quoted(_P1)}, 3) WHEN 2 THEN regexp_extract(line, {quoted(_P2)}, 2) END AS INTEGER) AS page,
  regexp_replace(CASE shape WHEN 1 THEN regexp_extract(line, {quoted(_P1)}, 1) WHEN 3 THEN regexp_extract(line, {quoted(_P3)}, 1) END, '\\.+$', '') AS section_number FROM f WHERE shape IS NOT NULL),
k AS (SELECT *, coalesce(section_number, 'section_' || row_number() OVER (PARTITION BY file ORDER BY ord)) AS section_key FROM g)
SELECT file, min(ord) AS ord, section_key, arg_max(title, ord) AS title, arg_max(page, ord) FILTER (WHERE page IS NOT NULL) AS page, arg_max(section_number, ord) FILTER (WHERE section_number IS NOT NULL) AS section_number FROM k GROUP BY file, section_key""")
def toc_parse(spark, sf_dir):
    toc = spark.createDataFrame([("toc", i, x) for i, x in enumerate(_TOC, 1)], "file string, ord int, line string")
    return L.parse_toc(lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.col("ln").alias("ord"), "line").union(toc))


# Documents as pages of files; what a file's table of contents is parsed from is the first of its first pages that names one.
_HEADINGS = _any("text", fixed.TOC_HEADINGS)


@register(f"""WITH p AS (SELECT {FILE} AS file, CAST(row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) AS INTEGER) AS page_number, CASE WHEN doc_id % 4 = 0 THEN 'Indice' || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents)
SELECT file, page_number, text FROM p WHERE page_number <= {fixed.TOC_PAGES} AND {_HEADINGS} QUALIFY row_number() OVER (PARTITION BY file ORDER BY page_number) = 1""")
def toc_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Indice\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("doc_id"))
    return L.toc_page(docs.withColumn("file", file_of()).withColumn("page_number", nth).select("file", "page_number", "text"))


@register(f"""SELECT doc_id, list_transform(list_filter(list_transform([source, ' ' || upper(source) || ' ', '', 'il la', lang], lambda n: {{'o': n, 'n': CASE WHEN n IS NULL THEN '' ELSE {normal_sql(clean_sql('n'))} END}}), lambda p: p.n <> ''), lambda p: p.o || '/' || p.n) AS names FROM documents""")
def normalize_name_lists(spark, sf_dir):
    listed_ = F.array("source", F.concat(F.lit(" "), F.upper("source"), F.lit(" ")), F.lit(""), F.lit("il la"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(N.normalize_names(listed_), lambda p: F.concat_ws("/", p["nome_originale"], p["nome_normalizzato"])).alias("names"))


# Every first line of a source is a title.
_TITLES = f"""(SELECT source AS file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS ord, line AS title FROM {LINES} WHERE ln = 0)"""
_STOPS = listed(fixed.TOC_STOP_WORDS)


_TOC_MATCH = f"""(WITH t AS (SELECT file, title, min(ord) AS ord, list_distinct(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '' AND NOT list_contains({_STOPS}, w))) AS tw FROM (
  SELECT file, ord, regexp_replace(upper({strip_sql('title')}), '\\s+', ' ', 'g') AS title FROM {_TITLES}) GROUP BY file, title), l AS (
  SELECT source AS file, doc_id * 100000 + ln AS line_id, regexp_replace(upper(regexp_replace({strip_sql("regexp_replace(line, '^\\d+(\\.\\d+)*\\.?\\s*', '')")}, '\\s+', ' ', 'g')), '^(FIGURA|TABELLA|STEP|F\\s+IGURA)\\s*\\d+\\s*[-–]?\\s*', '') AS text FROM {LINES}),
x AS (SELECT file, text, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND NOT list_contains({_STOPS}, w))) AS lw FROM (SELECT DISTINCT file, text FROM l)),
m AS (SELECT x.file, text, min(t.ord) AS toc_ord FROM x JOIN t ON x.file = t.file WHERE text = title OR (len(text) > 5 AND len(title) > 5 AND len(tw) > 0 AND len(list_intersect(tw, lw)) >= least(2.0, len(tw) * 0.6)) GROUP BY x.file, text)
SELECT l.file, line_id, toc_ord FROM l JOIN m ON l.file = m.file AND l.text = m.text)"""


@register(f"SELECT * FROM {_TOC_MATCH}")
def toc_match(spark, sf_dir):
    rows = lines(spark, sf_dir)
    first = Window.partitionBy("source").orderBy("doc_id")
    toc = rows.where("ln = 0").withColumn("ord", F.row_number().over(first)).select(F.col("source").alias("file"), "ord", F.col("line").alias("title"))
    return L.match_toc(rows.select(F.col("source").alias("file"), (F.col("doc_id") * 100000 + F.col("ln")).alias("line_id"), "line"), toc)


@register(f"""WITH l AS (SELECT doc_id, ln, line FROM {LINES} UNION ALL SELECT -i AS doc_id, CAST(i AS INTEGER) AS ln, s[i] AS line FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM (SELECT {listed(_SAMPLE_LINES)} AS s))), t AS (SELECT line_id FROM {_TOC_MATCH})
SELECT doc_id, ln, CASE WHEN {_CAPTION} THEN 'caption' WHEN {_HEADER} THEN 'header_footer' WHEN {_LIST} THEN 'list' WHEN line_id IS NOT NULL THEN 'toc_title' WHEN {_SECTION} THEN 'title' ELSE 'paragraph' END AS kind FROM l LEFT JOIN t ON line_id = doc_id * 100000 + ln""")
def line_classify(spark, sf_dir):
    extra = spark.createDataFrame([(-i, i, x) for i, x in enumerate(_SAMPLE_LINES, 1)], "doc_id long, ln int, line string")
    rows = lines(spark, sf_dir).select("doc_id", "ln", "line").union(extra).withColumn("line_id", F.col("doc_id") * 100000 + F.col("ln"))
    titled = toc_match(spark, sf_dir).select("line_id", F.lit(True).alias("in_toc"))
    size, bold = (F.lit(8) + F.length("line") % 8).cast("double"), F.col("ln") % 5 == 0
    return rows.join(titled, "line_id", "left").select("doc_id", "ln", L.line_kind(F.col("line"), F.coalesce("in_toc", F.lit(False)), size, bold).alias("kind"))


@register("""SELECT doc_id, 'Nome: ' || coalesce(source, 'None') || '. Tipo: ' || coalesce(lang, 'None') || '. Descrizione: ' || coalesce(d, 'None') || '.' || CASE WHEN len(v) > 0 THEN ' Varianti: ' || array_to_string(v, ', ') ELSE '' END AS text,
CASE WHEN len(v) > 3 THEN array_to_string(v[1:3], ', ') || '...' ELSE array_to_string(v, ', ') END AS shown
FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id END AS d, list_transform(generate_series(1, doc_id % 6), lambda i: lang || i) AS v FROM documents)""")
def embedding_text(spark, sf_dir):
    n = (F.col("doc_id") % 6).cast("int")
    v = F.transform(F.slice(F.array(*(F.lit(i) for i in range(1, 7))), F.lit(1), n), lambda i: F.concat("lang", i.cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("d"), v.alias("v"))
    return docs.select("doc_id", R.embedding_text(F.col("source"), F.col("lang"), F.col("d"), F.col("v")).alias("text"), R.variants_shown(F.col("v")).alias("shown"))


@register(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS word_count FROM documents""")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.token_count(F.col("text")).cast("long").alias("word_count"))


@register(f"SELECT conv_id, turn, len({strip_sql('text')}) > 0 AS valid, CAST(len(text) AS BIGINT) AS n_chars FROM conversations")
def question_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(N.strip(F.col("text"))) > 0).alias("valid"), F.length("text").cast("long").alias("n_chars"))


@register("""SELECT conv_id, turn, NOT ((g = '' OR contains(g, 'Nessuna')) AND (t = '' OR contains(t, 'Nessun'))) AS valid, list_filter([CASE WHEN g <> '' AND NOT contains(g, 'Nessuna') THEN g END, CASE WHEN t <> '' AND NOT contains(t, 'Nessun') THEN t END], lambda x: x IS NOT NULL) AS contexts
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Nessuna informazione' WHEN 1 THEN '' ELSE role END AS g, CASE conv_id % 3 WHEN 0 THEN text || ' Nessun testo' WHEN 1 THEN '' ELSE text END AS t FROM conversations)""")
def context_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    g = F.when(F.col("turn") % 3 == 0, "Nessuna informazione").when(F.col("turn") % 3 == 1, "").otherwise(F.col("role"))
    t = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" Nessun testo"))).when(F.col("conv_id") % 3 == 1, "").otherwise(F.col("text"))
    return rows.select("conv_id", "turn", R.graph_usable(g, t).alias("valid"), R.usable_contexts(g, t).alias("contexts"))


def _prompt_sql(kind: str, *fields: str) -> str:
    parts = R.PROMPTS[kind].split("%s")
    return " || ".join(quoted(part) + (f" || {field}" if field else "") for part, field in zip(parts, [*fields, ""], strict=True))


_PROMPTED = {
    "extraction": (quoted(", ".join(fixed.ENTITY_TYPES)), quoted(", ".join(fixed.RELATION_TYPES)), "'SezioneSconosciuta_' || item_id", "text"), "clustering": ("text", "''"), "analysis": ("'n' || item_id", "text"),
    "analysis_terms": (quoted(", ".join(fixed.QUESTION_ENTITY_TYPES)), "text"), "answer": ("text", quoted(R.NO_GRAPH), "text"),
}


@register(" UNION ALL ".join(f"SELECT item_id, {quoted(kind)} AS kind, {_prompt_sql(kind, *fields)} AS prompt FROM benchmark" for kind, fields in _PROMPTED.items()))
def prompt_render(spark, sf_dir):
    text, item = F.col("text"), F.col("item_id").cast("string")
    fields = {
        "extraction": (F.lit(", ".join(fixed.ENTITY_TYPES)), F.lit(", ".join(fixed.RELATION_TYPES)), N.section_name(F.lit(" "), F.concat(F.lit("c_"), item)), text), "clustering": (text, F.lit("")), "analysis": (F.concat(F.lit("n"), item), text),
        "analysis_terms": (F.lit(", ".join(fixed.QUESTION_ENTITY_TYPES)), text), "answer": (text, F.lit(R.NO_GRAPH), text),
    }
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), R.prompt(k, *v).alias("prompt")) for k, v in fields.items())))
    return table(spark, sf_dir, "benchmark").select("item_id", kinds.alias("p")).select("item_id", "p.kind", "p.prompt")


@register("""SELECT doc_id, 'Risposta.' || chr(10) || chr(10) || '**Fonti:**' || chr(10) || '* [' || source || ' guida.pdf](http://localhost/docs/' || url_encode(source) || '%20guida.pdf)' || chr(10) || '* [' || lang || '.pdf](http://localhost/docs/' || url_encode(lang) || '.pdf)' AS answer FROM documents""")
def source_links(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Risposta.\n\n**Fonti:**\n* "), "source", F.lit(" guida.pdf\n- "), "lang", F.lit(".pdf\n\nInformazioni aggiuntive: no")).alias("answer"))
    return rows.select("doc_id", R.link_sources(F.col("answer"), "http://localhost/docs/").alias("answer"))


_JSON = """CASE WHEN doc_id % 7 = 0 THEN '{"entita": [{"nome_entita"' WHEN doc_id % 7 = 1 THEN '' ELSE chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '{"entita": [{"nome_entita": "' || source || '", "tipo_entita": "' || CASE doc_id % 3 WHEN 0 THEN 'RuoloUtente' WHEN 1 THEN 'Altro' ELSE 'Scadenza' END
 || '", "descrizione_entita": "' || lang || '"}, {"tipo_entita": "Notifica"}], "relazioni": [{"soggetto": "' || source || '", "predicato": "' || CASE doc_id % 2 WHEN 0 THEN 'riguarda' ELSE 'boh' END || '", "oggetto": "' || lang || '"}]}' || chr(10) || chr(96) || chr(96) || chr(96) END"""


@register(f"""WITH r AS (SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(j, '^```(json)?', ''), '```$', '')")} AS j FROM (SELECT doc_id, {_JSON} AS j FROM documents)), p AS (SELECT doc_id, from_json(CASE WHEN json_valid(j) THEN j END, '{{"entita":[{{"nome_entita":"VARCHAR","tipo_entita":"VARCHAR","descrizione_entita":"VARCHAR"}}],"relazioni":[{{"soggetto":"VARCHAR","predicato":"VARCHAR","oggetto":"VARCHAR","contesto_relazione":"VARCHAR"}}]}}') AS x FROM r)
SELECT doc_id, list_transform(list_filter(coalesce(x.entita, []), lambda e: e.nome_entita IS NOT NULL AND list_contains({listed(fixed.ENTITY_TYPES)}, e.tipo_entita)), lambda e: e.nome_entita || '/' || e.tipo_entita) AS entities,
list_transform(list_filter(coalesce(x.relazioni, []), lambda r: r.soggetto IS NOT NULL AND r.oggetto IS NOT NULL AND list_contains({listed(fixed.RELATION_TYPES)}, r.predicato)), lambda r: r.soggetto || '/' || r.predicato || '/' || r.oggetto) AS relations FROM p""")
def llm_json_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_JSON).alias("j"))
    rows = rows.select("doc_id", R.parse(F.col("j"), R.EXTRACTION).alias("x"))
    return rows.select(
        "doc_id", F.transform(R.valid_entities(F.col("x")), lambda e: F.concat_ws("/", e["nome_entita"], e["tipo_entita"])).alias("entities"),
        F.transform(R.valid_relations(F.col("x")), lambda r: F.concat_ws("/", r["soggetto"], r["predicato"], r["oggetto"])).alias("relations"),
    )


_CLUSTERS = """CASE WHEN doc_id % 5 = 0 THEN 'no json' ELSE '{"entita_clusters": [{"membri_ids": [' || doc_id || '], "nome_cluster": "' || source || '"}, {"membri_ids": [], "nome_cluster": "vuoto"}], "relazioni_clusters": [{"membri_ids": [1, 2], "soggetto_cluster": "s", "predicato_cluster": "' || CASE doc_id % 4 WHEN 0 THEN 'riguarda' WHEN 1 THEN 'esegue tutto' WHEN 2 THEN 'richiede molto' ELSE 'altro' END || '", "oggetto_cluster": "o"}]}' END"""


@register(f"""WITH r AS (SELECT doc_id, {_CLUSTERS} AS j FROM documents), p AS (SELECT doc_id, from_json(CASE WHEN json_valid(j) THEN j END, '{{"entita_clusters":[{{"membri_ids":["INTEGER"],"nome_cluster":"VARCHAR"}}],"relazioni_clusters":[{{"membri_ids":["INTEGER"],"predicato_cluster":"VARCHAR"}}]}}') AS x FROM r)
SELECT doc_id, list_transform(list_filter(coalesce(x.entita_clusters, []), lambda c: len(c.membri_ids) > 0), lambda c: c.nome_cluster) AS entity_clusters,
list_transform(list_filter(coalesce(x.relazioni_clusters, []), lambda c: len(c.membri_ids) > 0), lambda c: CASE WHEN list_contains({listed(fixed.RELATION_TYPES)}, c.predicato_cluster) THEN c.predicato_cluster ELSE {keyword_sql('lower(c.predicato_cluster)', {v: [k] for k, v in fixed.CLOSEST_PREDICATES.items()}, quoted(fixed.DEFAULT_PREDICATE))} END) AS predicates FROM p""")
def clustering_json_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CLUSTERS).alias("j"))
    rows = rows.select("doc_id", R.parse(F.col("j"), R.CLUSTERING).alias("x"))
    return rows.select("doc_id", F.transform(R.entity_clusters(F.col("x")), lambda c: c["nome_cluster"]).alias("entity_clusters"), F.transform(R.relation_clusters(F.col("x")), lambda c: c["predicato_cluster"]).alias("predicates"))


_ANALYSIS = """CASE item_id % 4 WHEN 0 THEN '{"intento": "find_definition", "entita_chiave": [{"nome": "n' || item_id || '", "tipo": "Scadenza"}], "termini_di_ricerca_espansi": ["a", "b"]}' WHEN 1 THEN '{"intento": "generic_search", "entita_chiave": []}' WHEN 2 THEN '{"intento": "x"' ELSE '{"entita_chiave": [], "termini_di_ricerca_espansi": []}' END"""


@register(f"""SELECT item_id, CASE WHEN whole THEN i END AS intento, CASE WHEN whole THEN e END AS entities, CASE WHEN whole THEN text END AS domanda FROM (SELECT item_id, text, json_extract_string(j, '$.intento') AS i, CAST(json_extract_string(j, '$.entita_chiave[*].nome') AS VARCHAR[]) AS e,
json_extract_string(j, '$.intento') IS NOT NULL AND json_extract(j, '$.entita_chiave') IS NOT NULL AND json_extract(j, '$.termini_di_ricerca_espansi') IS NOT NULL AS whole FROM (SELECT item_id, text, CASE WHEN json_valid({_ANALYSIS}) THEN {_ANALYSIS} END AS j FROM benchmark))""")
def analysis_json_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", R.analysis(F.expr(_ANALYSIS), F.col("text")).alias("a"))
    return rows.select("item_id", F.col("a.intento").alias("intento"), F.transform("a.entita_chiave", lambda e: e["nome"]).alias("entities"), F.col("a.domanda_originale").alias("domanda"))


_GRAPH_JSON = """'{"nodes": [{"id": "n1", "label": "RuoloUtente", "properties": {"name": " Nodo  ' || source || '"}}, {"id": "n2", "label": "Notifica", "properties": {"name": "' || lang || '", "description": "d"}}, {"id": "n1", "label": "Altro", "properties": {"name": "Ultimo ' || source || '"}}, {"id": "n3", "properties": {}}], "relationships": [{"type": "genera", "start_node_id": "n1", "end_node_id": "n2", "properties": {"context": "c"}}, {"type": "usa", "start_node_id": "n1", "end_node_id": "n9"}, {"start_node_id": "n1", "end_node_id": "n2"}]}'"""


@register("""SELECT 'ultimo ' || source AS soggetto, 'genera' AS predicato, lower(lang) AS oggetto, 'c' AS contesto_relazione, CAST(doc_id AS VARCHAR) AS source_chunk_id FROM documents""")
def node_edge_adapter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_number"), F.from_json(F.expr(_GRAPH_JSON), R.NODES_EDGES).alias("r"))
    _, relations = aggregate.adapt_node_edge_format(rows)
    return relations.select("soggetto", "predicato", "oggetto", "contesto_relazione", "source_chunk_id")


@register("""SELECT 'nodo ' || source AS nome_entita, 'RuoloUtente' AS tipo_entita, CAST(doc_id AS VARCHAR) AS source_chunk_id FROM documents UNION ALL SELECT lower(lang), 'Notifica', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'ultimo ' || source, 'Altro', CAST(doc_id AS VARCHAR) FROM documents""")
def node_edge_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_number"), F.from_json(F.expr(_GRAPH_JSON), R.NODES_EDGES).alias("r"))
    entities, _ = aggregate.adapt_node_edge_format(rows)
    return entities.select("nome_entita", "tipo_entita", "source_chunk_id")


@register("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT DISTINCT name FROM {MENTIONS}")
def vocabulary(spark, sf_dir):
    return readers.vocabulary(mentions(spark, sf_dir).withColumnRenamed("name", "nome_entita_cluster"))


@register(f"SELECT doc_id, source FROM documents WHERE list_contains(['en', 'fr'], lang) AND len({strip_sql('text')}) > 0")
def whitelist(spark, sf_dir):
    allowed = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return table(spark, sf_dir, "documents").where(~N.blank(F.col("text"))).join(allowed, "lang", "left_semi").select("doc_id", "source")
