"""Steps that must grow with their input: what is shuffled, written or held at once, and the same results as before."""

import re

import pandas as pd
from pyspark.sql import functions as F

from strataloom import checkpoints
from strataloom.functions import lines
from strataloom.operators import chunking, cluster, graph, retrieve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wanted_chunks_are_ranked_without_a_text_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "overlap_score", None)  # scores of pairs, each with its text
    ids = [-70, -1, 0, 63, 64, 200]
    questions = spark.createDataFrame([(q, f"uno due tre{i}") for i, q in enumerate(ids)], "question_id long, question string")
    texts = {f"c{k:02}": " ".join(w for j, w in enumerate(["Uno", "due", "tre0", "tre3", "tre5"]) if k >> j & 1) for k in range(32)}
    chunks = spark.createDataFrame([(c, t, "f", 1, "s") for c, t in texts.items()] + [("none", None, "f", 1, "s")], "chunk_id string, text string, source_file string, page_number int, section_title string")
    pairs = [(q, c) for i, q in enumerate(ids) for k, c in enumerate([*texts, "none"]) if (k + i) % 3]
    wanted = graph.marked(spark.createDataFrame(pairs, "question_id long, chunk_id string"), "chunk_id")
    assert sorted((r.question_id, r.chunk_id) for r in graph.unmarked(wanted).collect()) == sorted(pairs)
    expected = set()
    for i, q in enumerate(ids):
        asked = {"uno", "due", f"tre{i}"}
        ranked = sorted((-round(len(asked & set(texts.get(c, "").lower().split())) / 3, 6), c) for p, c in pairs if p == q)
        expected |= {(q, c, n, -s) for n, (s, c) in enumerate(ranked[:5], 1)}
    assert {(r.question_id, r.chunk_id, r["rank"], r.score) for r in retrieve.rank_chunks(questions, wanted, chunks).collect()} == expected


def test_questions_of_a_block_share_a_found_row(spark):
    nodes = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("z", "c2"), ("y", "c3")], "name string, source_chunk_id string")
    edges = spark.createDataFrame([(1, "z", "a", "t"), (2, "z", "z", "t")], "edge_id long, src string, dst string, type string")
    asked = [(q, "a") for q in range(64)] + [(64, "z"), (3, "y")]
    found = graph.expand(graph.marked(spark.createDataFrame(asked, "question_id long, name string")), nodes, edges)
    assert found.count() == 6
    expected = {(q, n) for q in range(64) for n in "abz"} | {(64, "z"), (64, "a"), (3, "y")}
    assert {(r.question_id, r.name) for r in graph.unmarked(found).collect()} == expected


def test_texts_meet_terms_in_their_rows(spark):
    terms = spark.createDataFrame([("9",), ("Nation 1",)], "term string")
    texts = spark.range(100).select(F.concat(F.lit("nation "), F.col("id").cast("string")).alias("id")).withColumn("text", F.col("id"))
    found = graph._holding(terms, texts)
    assert "hashpartitioning" not in plan(found)
    assert {(r.term, r.id) for r in found.collect()} == {(t, f"nation {i}") for t in ("9", "Nation 1") for i in range(100) if t.lower() in f"nation {i}"}


def test_numbers_of_an_order_need_no_single_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("x"))
    got = cluster.numbered(rows, ["k"], "n")
    assert "SinglePartition" not in plan(got)
    assert sorted((r.k, r.n) for r in got.collect()) == [(k, k + 1) for k in range(1000)]
    assert cluster.numbered(rows.where("false"), ["k"]).count() == 0


def test_many_batches_cross_to_python_at_once(spark):
    def provider(entities, relations):
        if not len(entities):
            raise RuntimeError
        assert list(entities.index) == list(range(len(entities))) and list(relations.index) == list(range(4))
        return entities[["batch"]].head(1).assign(n=len(entities) + len(relations), none=None)

    rows = lambda n: spark.range(n).withColumnRenamed("id", "idx")
    got = cluster.cluster_together(rows(1000), rows(2400), provider, "batch long, n long, none string", (2, 4))
    assert str(cluster.BATCHES) in plan(got)  # what the groups are made by
    assert sorted((r.batch, r.n, r.none) for r in got.collect()) == [(b, 6, None) for b in range(500)]
    got = cluster.cluster_in_batches(rows(1001), lambda f: f[["batch"]].head(1) if f["batch"][0] % 2 else None, "batch long", 2)
    assert str(cluster.BATCHES) in plan(got)
    assert sorted(r.batch for r in got.collect()) == list(range(1, 501, 2))


def test_equal_arrays_are_one_before_they_are_shuffled(spark):
    clusters = spark.createDataFrame([(1, "s", "p", "o", list(range(1000)))], "cluster_id long, soggetto_cluster string, predicato_cluster string, oggetto_cluster string, membri_ids array<int>")
    arrays = lambda *xs: F.array(*(F.lit(x) for x in xs))
    relations = spark.range(1000).select(F.col("id").alias("idx"), F.lit("p").alias("predicato_norm"), arrays("b", "a", "").alias("contesti"), F.array(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("fonti_chunk_id"), arrays().cast("array<string>").alias("fonti_sezione"), F.lit(1).alias("conteggio_occorrenze"))
    got = cluster.merge_relation_clusters(clusters, relations)
    assert "collect_list" not in plan(got)
    (r,) = got.collect()
    assert (r.contesti_aggregati, r.fonti_aggregate_chunk_id, r.fonti_aggregate_sezione, r.conteggio_occorrenze_totale) == (["a", "b"], ["c0", "c1", "c2"], [], 1000)


def test_results_of_several_runs_are_passed_on_at_once(spark):
    class Chunks:
        """Rows as ``mapInPandas`` hands them out, without Spark."""

        dtypes = [("id", "bigint"), ("text", "string"), ("source", "string")]

        def where(self, _):
            return self

        def mapInPandas(self, run, schema):
            assert schema == "id long, n int, source string"
            ids = range(100)
            return list(run(iter([pd.DataFrame({"id": ids, "text": "t", "source": [f"s{i}" for i in ids]})])))

    def provider(frame):
        assert list(frame.index) == list(range(len(frame)))
        return frame[["id"]].assign(n=1).iloc[::-1] if frame["id"].iloc[0] % 7 else None

    (got,) = cluster.extract_in_batches(Chunks(), provider, "id long, n int", ["source"], size=2)
    expected = [i for i in range(100) if (i - i % 2) % 7]
    assert sorted(got.itertuples(index=False, name=None)) == [(i, 1, f"s{i}") for i in expected]


def test_a_common_word_does_not_meet_every_later_title(spark, monkeypatch):
    rows, plans = [], []
    monkeypatch.setattr(lines, "cut", lambda df: rows.append(df.count()) or plans.append(plan(df)) or checkpoints.cut(df))
    n = 400
    toc = [("f", i, f"Comune voce{i} nome{i}") for i in range(1, n + 1)] + [("f", n + 1, "Sola"), ("f", n + 2, "solitaria")]
    said = [f"comune riga{i}" for i in range(n)] + [f"comune nome{i}" for i in range(1, n, 50)] + ["nome7 voce7 nome300", "una solitaria comune", "SOLA", "Comune  voce9 nome9"]
    given = spark.createDataFrame([("f", i, x) for i, x in enumerate(said)], "file string, line_id long, line string")
    met = lines.match_toc(given, spark.createDataFrame(toc, "file string, ord int, title string"))
    expected = {(n + k, 1 + 50 * k) for k in range(8)} | {(n + 8, 7), (n + 9, n + 2), (n + 10, n + 1), (n + 11, 9)}
    assert {(r.line_id, r.toc_ord) for r in met.collect()} == expected
    assert sum(rows) < 20 * n  # all lines with all titles are n * n
    assert sum(bool(re.search(r"Aggregate\(keys=\[[^\]]*_text", p)) for p in plans) == 1  # rounds go by numbers, not by whole texts


def test_only_the_first_names_of_a_term_meet_the_edges(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: rows.append(out.count()) or out)(checkpoints.cut(df)))
    nodes = spark.range(500).select(F.concat(F.lit("node "), F.col("id").cast("string")).alias("name"))
    edges = spark.range(499).select(F.col("id").alias("edge_id"), F.concat(F.lit("node "), F.col("id").cast("string")).alias("src"), F.concat(F.lit("node "), (F.col("id") + 1).cast("string")).alias("dst"), F.lit("t").alias("type"))
    got = graph.search_or_neighbors(spark.createDataFrame([("Node",)], "term string"), nodes, edges, 4).collect()
    assert sorted((r.name, r.neighbor) for r in got) == [("node 0", "node 1"), ("node 1", "node 0"), ("node 1", "node 2"), ("node 10", "node 11")]
    assert rows[-1] == 4


def test_an_end_walked_from_as_a_source_is_not_walked_from_again(spark, monkeypatch):
    met = []
    monkeypatch.setattr(graph, "cut", lambda df: met.append(df.columns == ["dst"]) or checkpoints.cut(df))
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "t") for i in range(6)], "edge_id long, src string, dst string, type string")
    pairs = spark.createDataFrame([("n0", "n4"), ("n4", "n0"), ("n0", "n6"), ("n6", "zz")], "src string, dst string")
    assert sorted((r.src, r.dst, r.length) for r in graph.shortest_lengths(pairs, edges).collect()) == [("n0", "n4", 4), ("n0", "n6", 6), ("n4", "n0", 4)]
    assert any(met)


def test_a_sentence_is_counted_once(spark):
    packed = chunking.pack(chunking.sentences(F.col("text")), 4)
    step = packed._jc.toString() if hasattr(packed, "_jc") else str(packed)
    assert step.count("regexp_extract_all") == 1
    rows = spark.createDataFrame([("Uno due. Tre quattro! Cinque?",), ("Uno due tre quattro cinque. Sei.",), ("",)], "text string")
    assert [r.c for r in rows.select(packed.alias("c")).collect()] == [["Uno due.", "Tre quattro!", "Cinque?"], ["Uno due tre quattro cinque.", "Sei."], []]
