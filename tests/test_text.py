"""Names, lines and responses on small cases."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import lines as L
from strataloom.functions import names as N
from strataloom.functions import responses as R


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, tuple) else v[1]}" for k, v in values.items())
    row = tuple(v[0] if isinstance(v, tuple) else v for v in values.values())
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("criterio", "procedura"), ("Albo pretorio", "albo fornitori"), ("Registrazione Albo", "iscrizione"), ("PAROLA D'ACCESSO", "password"), ("il la", "il la"), ("  Il Responsabile del Procedimento ", "responsabile procedimento"), ("", ""), ("\t", ""), (None, ""), ("D’accordo", "d’accordo")],
)
def test_normalize(spark, name, expected):
    assert one(spark, N.normalize_entity_name(F.col("n")), n=name) == expected


def test_keywords_keep_order_and_drop_repeats(spark):
    assert one(spark, N.keywords(F.col("t")), t="La ditta e l'impresa con moduli moduli") == ["fornitore", "moduli"]
    assert one(spark, N.keywords(F.col("t")), t=None) == []


def test_search_patterns(spark):
    found = one(spark, N.search_patterns(F.col("n")), n="Login portale")
    assert found[0] == "login portale" and found[1] == "accesso" and "autenticazione" in found and len(found) == len(set(found))


def test_predicates(spark):
    assert one(spark, N.safe_predicate(F.col("p")), p="è l'esito") == "e_lesito"
    assert one(spark, N.closest_predicate(F.col("p")), p="può eseguire") == "riguarda"
    assert one(spark, N.infer_relation_type(F.col("p")), p="CREA file") == "genera"
    assert one(spark, N.section_name(F.col("t"), F.col("c")), t=" ", c="a_section_7") == "SezioneSconosciuta_7"


@pytest.mark.parametrize(
    ("line", "kind"),
    [("FIGURA 3 - Accesso", "caption"), ("PROPRIETÀ riservata", "header_footer"), ("ab", "header_footer"), ("1. Primo passo", "list"), ("• voce", "list"), ("LISTA ATTIVITÀ BLOCCANTI", "title"), ("3.2 Accesso al sistema", "title"), ("Una riga normale di testo.", "paragraph")],
)
def test_line_kind(spark, line, kind):
    assert one(spark, L.line_kind(F.col("l"), F.lit(False)), l=line) == kind


def test_clean_text(spark):
    text = "Pag. 3\nVers. 1.2\n  questa riga contieneParole 12abc  \nFIGURA 1\ncorta\nuna riga - con ... punti"
    assert one(spark, L.clean_text(F.col("t")), t=text) == "questa riga contiene Parole 12 abc una riga con punti"
    assert one(spark, L.clean_text(F.col("t")), t=None) == ""


def test_toc_keeps_first_place_and_last_value(spark):
    rows = [("f", 0, "1. INTRODUZIONE .... 3"), ("f", 1, "5. PRIMO ACCESSO"), ("f", 2, "1. INTRODUZIONE NUOVA .... 9")]
    found = {r.section_key: r for r in L.parse_toc(spark.createDataFrame(rows, "file string, ord int, line string")).collect()}
    assert (found["1"].ord, found["1"].title, found["1"].page) == (0, "INTRODUZIONE NUOVA", 9)
    assert (found["5"].title, found["5"].page) == ("PRIMO", None)  # a title without a page stops at white space


def test_style_average(spark):
    spans = ([("a", 14.0, 16), ("b", 12.0, 0)], "array<struct<text: string, size: double, flags: int>>")
    size, bold = L.style_average(F.col("s"))
    assert one(spark, size, s=spans) == 13.0 and one(spark, bold, s=spans) is True


def test_parse_rejects_malformed(spark):
    assert one(spark, R.parse(F.col("j"), R.EXTRACTION), j='{"entita": [') is None
    assert one(spark, R.parse(F.col("j"), R.EXTRACTION), j=None) is None
    good = one(spark, R.valid_entities(R.parse(F.col("j"), R.EXTRACTION)), j='```json\n{"entita": [{"nome_entita": "a", "tipo_entita": "Scadenza"}, {"nome_entita": "b", "tipo_entita": "X"}]}\n```')
    assert [e.nome_entita for e in good] == ["a"]


def test_context_gate(spark):
    gate = R.graph_usable(F.col("g"), F.col("t"))
    assert one(spark, gate, g=R.NO_GRAPH, t="") is False
    assert one(spark, gate, g=R.NO_GRAPH, t="testo") is True
    assert one(spark, R.usable_contexts(F.col("g"), F.col("t")), g="grafo", t="Nessun dato") == ["grafo"]


def test_source_links(spark):
    out = one(spark, R.link_sources(F.col("a"), "http://h/"), a="Testo.\nFonti:\n* a b/c.pdf\n- d.pdf\n\nInformazioni aggiuntive: x")
    assert out == "Testo.\n**Fonti:**\n* [a b/c.pdf](http://h/a%20b/c.pdf)\n* [d.pdf](http://h/d.pdf)"
    assert one(spark, R.link_sources(F.col("a"), "http://h/"), a="senza elenco") == "senza elenco"


def test_lists_of_names_and_terms(spark):
    got = spark.range(1).select(N.normalize_names(F.array(F.lit("Login"), F.lit(" "), F.lit(None), F.lit("ditta"))).alias("x")).first()[0]
    assert [(r.nome_originale, r.nome_normalizzato) for r in got] == [("Login", "accesso"), ("ditta", "fornitore")]
    terms = lambda a, b: spark.range(1).select(N.search_terms(a, b).alias("x")).first()[0]
    assert terms(F.array(F.lit("A b"), F.lit("")), F.array(F.lit("a B"), F.lit("c"))) == ["a b", "c"]
    assert terms(F.lit(None).cast("array<string>"), F.array(F.lit("c"))) == ["c"]


def test_toc_is_parsed_from_the_first_page_that_names_one(spark):
    pages = [("f", 1, "Copertina"), ("f", 3, "Sommario\n1. INTRODUZIONE ...... 4"), ("f", 4, "Indice\n2. ALTRO TITOLO ..... 5"), ("g", 6, "Indice\n1. TARDI ..... 5")]
    got = L.toc_of_pages(spark.createDataFrame(pages, "file string, page_number int, text string")).collect()
    assert [(r.file, r.title, r.page, r.section_number) for r in got] == [("f", "INTRODUZIONE", 4, "1")]
