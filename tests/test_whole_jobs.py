"""Queries over whole tables against brute force, where the SQL counterparts see a part only."""

import re
from collections import defaultdict

import regex
from conftest import DATA

from strataloom.operators import retrieve
from strataloom.plans import retrieval, tables, text


def test_shortest_paths_search_the_whole_graph(spark):
    links = defaultdict(set)
    for r in tables.graph_edges(spark, DATA).select("src", "dst").distinct().collect():
        links[r.src].add(r.dst)
        links[r.dst].add(r.src)
    expected = {}
    for a in range(25):
        src, dst = f"nation {a}", f"nation {(a * 7 + 5) % 25}"
        front, seen, d = {src}, {src}, 0
        while front and dst not in front and d < 10:
            front = {y for x in front for y in links[x]} - seen
            seen |= front
            d += 1
        if dst in front:
            expected[src, dst] = d
    assert len(expected) > 5
    assert {(r.src, r.dst): r.length for r in retrieval.shortest_path_len(spark, DATA).collect()} == expected


def test_chunks_near_by_vector_only_are_retrieved(spark):
    questions = spark.createDataFrame([(1, "una domanda", [1.0, 0.0]), (2, "altro", None)], "question_id long, question string, embedding array<double>")
    terms = spark.createDataFrame([], "question_id long, term string")
    nodes = spark.createDataFrame([("a", "c1", ["a"]), ("b", "c2", ["b"]), ("z", "c4", ["z"])], "name string, source_chunk_id string, original_names array<string>")
    edges = spark.createDataFrame([(1, "b", "a", "usa")], "edge_id long, src string, dst string, type string")
    chunks = spark.createDataFrame([(f"c{i}", "una domanda" if i == 3 else "testo", "f", 1, "s") for i in range(1, 5)], "chunk_id string, text string, source_file string, page_number int, section_title string")
    vectors = spark.createDataFrame([(1, "c1", [0.9, 0.1]), (3, "c3", [0.8, 0.1]), (4, "c4", [-1.0, 0.0])], "id long, chunk_id string, embedding array<double>")
    got = retrieve.retrieve_raw(questions, terms, nodes, edges, chunks, chunk_vectors=vectors, top_k=2).collect()
    # c1 and c3 by their vectors, c3 without any node; c2 over the edge of c1's node
    assert [(r.question_id, r["rank"], r.chunk_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, "c3"), (1, 2, "c1"), (1, 3, "c2")]


def test_rerank_scores_every_document(spark):
    def words(text):
        return set((text or "").lower().split())

    chunks = [(r.source + f"_section_{r.doc_id}", words(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    expected = set()
    for q in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        asked = words(q.text)
        ranked = sorted((-round(len(asked & c) / max(len(asked), 1), 6), name) for name, c in chunks)
        expected |= {(q.item_id, name, k) for k, (_, name) in enumerate(ranked[:5], 1)}
    assert {(r.question_id, r.chunk_id, r["rank"]) for r in retrieval.rerank_top5(spark, DATA).collect()} == expected


def test_toc_has_every_title_whole(spark, tmp_path):
    shared = ["comune", "testo", "di", "prova"]
    docs = [(i, f"s{i % 2}", f"{shared[i % 4]} primo uno due tre{i} quattro{i}\n{i}. tre{i - 8} quattro{i - 8} altro\nniente", "it", 0) for i in range(80)]
    docs += [(80, "s0", "solo\nil testo\n" + "parole comuni di tutti", "it", 0), (81, "s0", "parola\nParola in fine", "it", 0)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bare = lambda x: {w for w in x.split() if w not in text.fixed.TOC_STOP_WORDS}
    titles, expected = defaultdict(list), set()
    for _, source, body, *_ in docs:
        titles[source].append(" ".join(body.split("\n")[0].upper().split()))
    for i, source, body, *_ in docs:
        for ln, line in enumerate(body.split("\n")):
            x = " ".join(re.sub(r"^\d+(\.\d+)*\.?\s*", "", line).upper().split())
            same = [k for k, t in enumerate(titles[source], 1) if x == t or len(x) > 5 and len(t) > 5 and bare(t) and len(bare(t) & bare(x)) >= min(2.0, len(bare(t)) * 0.6)]
            expected |= {(source, i * 100000 + ln, min(same))} if same else set()
    assert max(k for *_, k in expected) > 16
    assert {(r.file, r.line_id, r.toc_ord) for r in text.toc_match(spark, str(tmp_path)).collect()} == expected


def test_every_long_word_of_a_question_is_a_term(spark):
    got = {(r.question_id, r.term) for r in retrieval._question_terms(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    expected = {(r.item_id, w) for r in rows for w in re.findall(r"[^\W\d_]{7,}", r.text.lower()) + [x.lower() for x in regex.findall(r"\p{Lu}\p{L}{5,}", r.text)]}
    assert got == expected and len(got) > 3 * len({q for q, _ in got})


def test_search_and_requirements_see_every_node(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_TERMS", [*retrieval._TERMS, "order 1", "ART 9"])
    names = [r.name for r in tables.graph_nodes(spark, DATA).select("name").collect()]
    links, of = defaultdict(set), defaultdict(list)
    for r in tables.graph_edges(spark, DATA).collect():
        links[r.src].add(r.dst)
        links[r.dst].add(r.src)
        of[r.src, r.type.lower()].append(r.dst)
    expected = set()
    for term in retrieval._TERMS:
        rows = sorted((n, x) for n in names if term.lower() in n.lower() for x in links[n] or [""])
        expected |= {(term, n, x or None) for n, x in rows[:10]}
    assert {(r.term, r.name, r.neighbor) for r in retrieval.fallback_search(spark, DATA).collect()} == expected
    assert any(n.startswith("order ") for _, n, _ in expected)
    rows = sorted((n, a, b) for n in names for a in of[n, "haprerequisito"] or [""] for b in of[n, "richiededocumento"] or [""])
    assert sorted((r.start, r.prerequisite or "", r.document or "") for r in retrieval.requirements_join(spark, DATA).collect()) == rows
