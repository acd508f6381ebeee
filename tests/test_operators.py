"""Aggregation, clusters, graph, chunks, retrieval, evaluation, files and streams on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from strataloom.operators import aggregate, chunking, cluster, evaluate, graph, retrieve
from strataloom.sources import readers, writers
from strataloom.streaming import ingest

RAW = "ord long, " + readers.ENTITIES_RAW


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_mode_ties_go_to_the_first_seen(spark):
    rows = [(1, "Alfa", "B", " d1 ", "c1", 2, None), (2, "alfa", "A", "d1", "c2", None, "s"), (3, "ALFA", "A", "", "c1", 1, "s"), (4, "alfa", "B", None, "", 1, ""), (5, " ", "A", None, None, None, None), (6, None, "A", None, None, None, None)]
    (got,) = aggregate.aggregate_entities(raw(spark, rows)).collect()
    assert got.nome_entita_canonico_provvisorio == "alfa" and got.tipo_entita_canonico_provvisorio == "B"
    assert (got.tutti_nomi_originali, got.descrizioni_aggregate, got.fonti_chunk_id, got.fonti_pagina, got.fonti_sezione, got.conteggio_occorrenze) == (["ALFA", "Alfa", "alfa"], ["d1"], ["c1", "c2"], [1, 2], ["s"], 4)
    assert aggregate.aggregate_entities(raw(spark, [])).count() == 0


def test_merge_nodes_keeps_first_fields_and_name_order(spark):
    rows = [(3, "login", "T3", "x", "c3", 3, "s"), (1, "Accesso", None, None, None, None, None), (2, "login", "T2", "y", "c2", 2, "s")]
    (got,) = aggregate.merge_nodes_raw(raw(spark, rows)).collect()
    assert (got.name, got.type, got.description, got.source_page_number, got.original_names, got.occurrence_count) == ("accesso", "Unknown", "", 0, ["Accesso", "login"], 3)


def test_edges_need_both_ends_and_stay_parallel(spark):
    nodes = spark.createDataFrame([("a1",), ("b1",)], "name string")
    rel = spark.createDataFrame([(1, "a1", "usa x", "b1"), (2, "a1", "usa x", "b1"), (3, "a1", "usa", "zz"), (4, " ", "usa", "b1")], "ord long, soggetto string, predicato string, oggetto string")
    for c in ("contesto_relazione", "source_chunk_id", "source_section_title"):
        rel = rel.withColumn(c, F.lit(None).cast("string"))
    got = aggregate.edges_raw(rel.withColumn("source_page_number", F.lit(None).cast("int")), nodes).collect()
    assert sorted((r.edge_id, r.predicate, r.context) for r in got) == [(1, "usa_x", ""), (2, "usa_x", "")]


def test_legacy_layout_is_upgraded(spark):
    old = spark.createDataFrame([("N", "n", "T", ["d"], 2)], "nome_entita_aggregato string, nome_entita_norm string, tipo_entita string, descrizioni array<string>, conteggio_occorrenze long")
    (got,) = aggregate.upgrade_layout(old).collect()
    assert (got.nome_entita_canonico_provvisorio, got.tutti_nomi_originali, got.descrizioni_aggregate) == ("N", ["N"], ["d"])


def test_greedy_clusters_skip_whole_clusters(spark):
    rows = [(0, 1, [1, 2]), (0, 2, [2, 3]), (0, 3, [3, 4]), (0, 4, []), (1, 1, [-1, 9]), (1, 2, [9])]
    got = cluster.accept_greedily(spark.createDataFrame(rows, "batch long, ord long, membri_ids array<int>")).collect()
    assert sorted((r.batch, r.ord) for r in got) == [(0, 1), (0, 3), (1, 1)]


def test_merge_clusters_ignores_unknown_ids(spark):
    entities = spark.createDataFrame([(0, ["b", ""], ["T"], ["d"], ["c"], 2), (1, ["a"], ["T"], [], ["c"], 3)], "idx int, tutti_nomi_originali array<string>, tutti_tipi_rilevati array<string>, descrizioni_aggregate array<string>, fonti_chunk_id array<string>, conteggio_occorrenze long")
    clusters = spark.createDataFrame([(1, "N", None, [0, 1, 99]), (2, "M", "T", [99])], "cluster_id int, nome_cluster string, tipo_cluster string, membri_ids array<int>")
    got = {r.nome_entita_cluster: r for r in cluster.merge_clusters(clusters, entities).collect()}
    assert (got["N"].membri_cluster, got["N"].conteggio_occorrenze_totale, got["N"].tipo_entita_cluster) == (["a", "b"], 5, "TipoSconosciuto")
    assert (got["M"].membri_cluster, got["M"].conteggio_occorrenze_totale) == ([], 0)


def test_failing_provider_leaves_singletons(spark):
    def provider(frame):
        if frame["idx"].min() == 0:
            raise ValueError("no answer")
        return frame.assign(name="x")[["name", "idx"]]

    got = cluster.cluster_in_batches(spark.range(4).withColumnRenamed("id", "idx"), provider, "name string, idx long", 2).collect()
    assert sorted(r.idx for r in got) == [2, 3]


def test_providers_are_tried_again_and_fail_to_nothing(spark):
    tries = {}

    def provider(frame):
        key = frame["chunk_id"].iloc[0]
        tries[key] = tries.get(key, 0) + 1
        if key == "c" or tries[key] < 3:
            raise ConnectionError("busy")
        return frame[["chunk_id"]].rename(columns={"chunk_id": "found"})

    chunks = spark.createDataFrame([("a", "x", 1), ("b", " ", 2), ("c", "y", 3)], "chunk_id string, text string, page_number int")
    got = cluster.extract_in_batches(chunks, provider, "found string", ["page_number"], size=1).collect()
    assert [(r.found, r.page_number) for r in got] == [("a", 1)]


def test_calls_hold_entities_and_relations_together(spark):
    def provider(entities, relations):
        return entities.assign(n=len(relations))[["idx", "n"]] if len(entities) else relations.assign(n=-1)[["idx", "n"]]

    rows = lambda n: spark.range(n).withColumnRenamed("id", "idx")
    got = cluster.cluster_together(rows(3), rows(9), provider, "idx long, n long", (2, 4)).collect()
    assert sorted((r.idx, r.n) for r in got) == [(0, 4), (1, 4), (2, 4), (8, -1)]


def test_relations_of_no_cluster_stay_single(spark):
    relations = spark.createDataFrame([(i, f"s{i}", "p", f"o{i}", ["x"], ["c"], ["t"], 2) for i in range(3)], "idx int, soggetto_norm string, predicato_norm string, oggetto_norm string, contesti array<string>, fonti_chunk_id array<string>, fonti_sezione array<string>, conteggio_occorrenze long")
    clusters = spark.createDataFrame([(1, "S", None, "O", [0, 2, 99])], "cluster_id int, soggetto_cluster string, predicato_cluster string, oggetto_cluster string, membri_ids array<int>")
    names = spark.createDataFrame([("s1", "Uno")], "member string, canonical string")
    got = {r.soggetto_cluster: r for r in cluster.finalize_relations(clusters, relations, names).collect()}
    assert (got["S"].predicato_cluster, got["S"].conteggio_occorrenze_totale, got["S"].contesti_aggregati) == ("Predicato_Sconosciuto", 4, ["x"])
    assert (got["Uno"].oggetto_cluster, got["Uno"].membri_ids_originali) == ("o1", [1]) and len(got) == 2


EDGES = "edge_id long, src string, dst string, type string"


def test_trails_do_not_repeat_edges(spark):
    edges = spark.createDataFrame([(1, "a", "b", "X"), (2, "b", "c", "x"), (3, "c", "a", "x"), (4, "a", "c", "y")], EDGES)
    starts = spark.createDataFrame([("a",)], "start string")
    found = graph.trails(starts, edges, ["x"]).collect()
    assert sorted(r.length for r in found) == [1, 2, 3]
    assert max(found, key=lambda r: r.length).nodes == ["a", "b", "c", "a"]
    assert [r.length for r in graph.longest(graph.trails(starts, edges, ["x"]), 1).collect()] == [3]


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, "a", "b", "t"), (2, "c", "b", "t"), (3, "c", "d", "t"), (4, "x", "y", "t"), (5, "b", "d", "t")], EDGES)
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "y"), ("d", "c")], "src string, dst string")
    got = {(r.src, r.dst): r.nodes for r in graph.shortest_paths(pairs, edges).collect()}
    assert got == {("a", "d"): ["a", "b", "d"], ("a", "a"): ["a"], ("d", "c"): ["d", "c"]}


def test_contains_join_equals_brute_force(spark):
    terms, texts = ["AB", "abc", "x", "", "lungo termine", "ß"], ["xabcx", "ab", "un LUNGO termine qui", "", "straße", None]
    got = graph.contains_join(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert {(r.term, r.id) for r in got} == {(t, i) for t in terms for i, x in enumerate(texts) if t and x and t.lower() in x.lower()}


def test_requirements_keep_starts_without_any(spark):
    edges = spark.createDataFrame([(1, "a", "p", "haPrerequisito"), (2, "a", "d", "RichiedeDocumento"), (3, "a", "e", "richiedeDocumento")], EDGES)
    got = graph.requirements(spark.createDataFrame([("a",), ("z",)], "start string"), edges).collect()
    assert sorted((r.start, r.prerequisite, r.document) for r in got if r.start == "a") == [("a", "p", "d"), ("a", "p", "e")]
    assert [(r.prerequisite, r.document) for r in got if r.start == "z"] == [(None, None)]


def test_every_intent_has_its_graph_query(spark):
    edges = spark.createDataFrame(
        [(1, "az", "p1", "haPassoSuccessivo"), (2, "p1", "p2", "includeOperazione"), (3, "p2", "p3", "altro"), (4, "req", "pre", "haPrerequisito"), (5, "d1", "n1", "x"), (6, "n2", "d1", "x"), (7, "n1", "z", "x")], EDGES
    )
    nodes = spark.createDataFrame([(n, "AzioneUtente" if n == "az" else "Altro") for n in ("az", "p1", "p2", "p3", "req", "pre", "d1", "n1", "n2", "z", "solo")], "name string, type string")
    asked = [
        (1, "find_procedure", ["az", "p1"]), (2, "find_requirements", ["req", "solo"]), (3, "find_definition", ["d1", "az"]), (4, "find_relationship", ["n2", "z", "az"]), (5, "find_relationship", ["n2"]), (6, "generic_search", ["n1"]),
        (7, "find_definition", ["SOLO"]), (8, "find_procedure", ["p1"]), (9, "find_requirements", ["solo"]), (10, None, ["az"]), (11, "find_definition", ["", None]), (12, "find_definition", []),
    ]
    got = {}
    for r in graph.find_by_intent(spark.createDataFrame(asked, "question_id long, intent string, entities array<string>"), nodes, edges).collect():
        got.setdefault(r.question_id, set()).add(r.name)
    assert got == {
        1: {"az", "p1", "p2"}, 2: {"req", "pre"}, 3: {"d1", "n1", "n2"}, 4: {"n2", "d1", "n1", "z"}, 5: {"n2", "d1"}, 6: {"n1", "d1", "z"},
        7: {"solo"}, 8: {"p1", "az", "p2"},
    }  # fmt: skip  # 8 falls back to its name, 9 is known and has nothing, 10 to 12 have no query


def test_vectors_of_a_failing_provider_are_null(spark):
    def provider(texts):
        if "bad" in texts:
            raise OSError("down")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r.embedding for r in retrieve.embed(rows.coalesce(1), provider, F.col("t")).orderBy(F.col("t").desc_nulls_last()).collect()] == [[3.0], None]
    assert retrieve.embed(spark.createDataFrame([("bad",)], "t string"), provider, F.col("t")).first().embedding is None
    with pytest.raises(ValueError, match="mode"):
        retrieve.ask(rows, rows, rows, rows, "other")


def test_batches_are_saved_once_and_discarded(spark, tmp_path):
    rows = spark.range(20)
    assert ingest.save_batches(rows, str(tmp_path / "b"), "id", 4) > 1
    assert ingest.save_batches(rows, str(tmp_path / "b"), "id", 4) == 0
    assert spark.read.parquet(str(tmp_path / "b")).count() == 20
    assert ingest.discard(spark, str(tmp_path / "b")) and not ingest.discard(spark, str(tmp_path / "b"))
    seen, figures = ingest.measured(rows)
    assert seen.count() == 20 and figures()["n"] == 20 and figures()["rows_per_second"] > 0


def test_vector_top_k_ties(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "question_id long, embedding array<double>")
    got = retrieve.vector_top_k(q, v, 2).collect()
    assert sorted((r.question_id, r["rank"], r.id) for r in got) == [(7, 1, 1), (7, 2, 3)]


def test_rerank_order(spark):
    rows = [(1, "come cambio password", f"c{i}", t) for i, t in enumerate(["niente", "cambio password", "password", None, "come cambio password"])]
    c = spark.createDataFrame(rows, "question_id long, question string, chunk_id string, text string")
    assert [r.chunk_id for r in retrieve.rerank(c, top_n=3).orderBy("rank").collect()] == ["c4", "c1", "c2"]
    assert [r.chunk_id for r in retrieve.rerank(c, None, None).orderBy("rank").collect()] == ["c0", "c1", "c2", "c3", "c4"]


def test_answers_without_context(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "question_id long, question string")
    g = spark.createDataFrame([(1, "grafo")], "question_id long, graph_context string")
    t = spark.createDataFrame([], "question_id long, text_context string")
    got = {r.question_id: r for r in retrieve.answers(q, g, t).collect()}
    assert got[1].contexts == ["grafo"] and got[2].contexts == [] and got[2].answer.startswith("Non ho trovato")


def test_packing(spark):
    items = ["a b c.", "d e.", "f g h i j k l m.", "n."]
    got = spark.createDataFrame([(items,)], "s array<string>").select(chunking.pack(F.col("s"), 7).alias("x")).first()[0]
    assert got == ["a b c. d e.", "f g h i j k l m.", "n."]
    pages = spark.createDataFrame([("f", 1, "Uno due. Tre quattro! Cinque"), ("f", 2, None)], "file string, page_number int, text string")
    assert [r.chunk_id for r in chunking.sentence_chunks(pages, 4).orderBy("chunk_id").collect()] == ["f_page_1_chunk_0", "f_page_1_chunk_1"]


def test_section_chunks_carry_titles(spark):
    pages = spark.createDataFrame([("f", 1, None, "zero."), ("f", 2, "T", "uno."), ("f", 3, None, "due."), ("f", 4, "U", "tre.")], "file string, page_number int, section_title string, text string")
    got = [(r.chunk_id, r.section_title, r.page_number, r.text) for r in chunking.section_chunks(pages).orderBy("chunk_id").collect()]
    assert got == [("f_section_0", None, 1, "zero."), ("f_section_1", "T", 3, "uno. due."), ("f_section_2", "U", 4, "tre.")]


def test_means_skip_nan(spark):
    rows = spark.createDataFrame([("q1", math.nan, 1.0), ("q2", 0.5, None), ("q3", 1.0, 0.0)], "user_input string, faithfulness double, answer_relevancy double").withColumns({"question_type": F.lit("a"), "difficulty": F.col("user_input")})
    got = {(r["grouping"], r.value): r for r in evaluate.grouped_means(rows, ["faithfulness", "answer_relevancy"]).collect()}
    assert got["all", ""].faithfulness == 0.75 and got["all", ""].n == 3 and got["difficulty", "q1"].faithfulness is None
    assert {r.which: r.user_input for r in evaluate.best_and_worst(rows).collect()} == {"best": "q3", "worst": "q2"}


def test_json_and_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 'testo "citato"\nriga', "f", None, None, "t", 3)], readers.CHUNKS)
    writers.write_json(rows, str(tmp_path / "j"))
    assert readers.read_chunks(spark, str(tmp_path / "j")).collect() == rows.collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{broken")
    assert readers.read_chunks(spark, str(tmp_path / "bad")).count() == 0
    (tmp_path / "array.json").write_text('[{"chunk_id": "a", "text": "x"}, {"chunk_id": "b"}]')
    assert readers.read_chunks(spark, str(tmp_path / "array.json")).count() == 2
    run = spark.createDataFrame([("q", "['a']", 'r "x"\ny', "ref", 0.5, None, 1.0, 0.0)], readers.EVALUATION)
    writers.write_csv(run, str(tmp_path / "c"))
    assert readers.read_evaluation(spark, str(tmp_path / "c")).collect() == run.collect()


def test_graph_files_and_chunk_table(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", "b", "usa"), (2, "b", "a", "genera")], "edge_id long, src string, dst string, predicate string")
    writers.write_graph(spark.createDataFrame([("a",), ("b",)], "name string"), edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).where("predicate = 'usa'").count() == 1
    chunks = spark.createDataFrame([("a", None), ("a", None), (None, 1)], "chunk_id string, page_number int")
    writers.write_chunk_table(chunks, str(tmp_path / "t"))
    writers.write_chunk_table(chunks.limit(0), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("a", 0)]


def test_binary_documents_isolate_bad_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def extract(content):
        if content == b"bad":
            raise LookupError("unreadable")
        return content.decode().split("\x0c")

    got = readers.read_documents(spark, str(tmp_path), extract).collect()
    assert sorted(((r.source_file, r.page_number or 0, r.text, r.error) for r in got)) == [("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("b.pdf", 0, None, "LookupError: unreadable")]
    whole = readers.read_documents(spark, str(tmp_path), lambda content: content.decode()).where("source_file = 'a.pdf'").collect()
    assert [(r.page_number, r.text) for r in whole] == [(1, "one\x0ctwo")]
    lines = readers.read_structured(spark, str(tmp_path), lambda content: [[[(content.decode()[:1], 12, 16)]]]).orderBy("source_file").collect()
    assert [(r.page_number, r.ln, r.spans[0].text, r.spans[0].flags) for r in lines] == [(1, 0, "o", 16), (1, 0, "b", 16)]
    assert readers.latest_file(spark, str(tmp_path), "*.txt").endswith("c.txt")


def test_stage_reuses_what_exists(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert ingest.stage(spark, str(tmp_path / "s"), compute).count() == 3
    assert len(calls) == 1


def test_stream_processes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"chunk_id": "a", "text": "x"}\n{"chunk_id": "b", "text": " "}')

    def run():
        q = ingest.ingest(spark, str(tmp_path / "in"), readers.CHUNKS, lambda b: b.where("trim(text) != ''").select("chunk_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        return sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a"] and run() == ["a"]
    (tmp_path / "in" / "2.json").write_text('{"chunk_id": "c", "text": "x"}')
    assert run() == ["a", "c"]


@pytest.mark.parametrize("module", ["functions", "operators", "sources", "plans", "streaming", "checkpoints"])
def test_library_does_not_import_the_corpus_subpackage(module):
    import pathlib
    import re

    base = pathlib.Path(__file__).parents[1] / "strataloom" / module
    files = base.rglob("*.py") if base.is_dir() else [base.with_suffix(".py")]
    assert not [f for f in files if re.search(r"^\s*(from|import)\b.*\bllm\b", f.read_text(), re.M)]
