"""The pipeline's stages, the registered queries and their SQL."""

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_keep_columns_and_rows_flow(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "sentencepiece_encoding"]
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        n = out.count()
        assert 0 < n and (n <= seen or name == "source_mixing")
        if name == "minhash_near_dedup":
            assert out.select("text").where("text != ''").distinct().count() == out.where("text != ''").count()
        docs, seen = out, n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert "ids" in last.columns and last.count() == seen


def test_stages_equal_brute_force(spark):
    import re
    from collections import Counter

    import sentencepiece
    from test_llm_documents import components, make

    from strataloom.llm.tokenizer_files import PIECES

    rows = [(i, t, lang, s, n) for i, t, lang, s, n in make(40)]
    docs = spark.createDataFrame(rows, DOCS)
    stage = dict(corpus_pipeline.STAGES)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i < max(holders[key(x)])
    expected = {i: None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t, *_ in rows}
    assert {r.doc_id: r.text for r in stage["line_dedup"](spark, docs, DATA).collect()} == expected
    found = components(rows, 5)
    assert sorted(r.doc_id for r in stage["minhash_near_dedup"](spark, docs, DATA).collect()) == sorted(i for i, (_, _, kept) in found.items() if kept)
    taken = {r.doc_id: (r.copies, r.size) for r in queries.mixing.decisions(docs.select("doc_id", "source", "text")).collect()}
    copies = Counter(r.doc_id for r in stage["source_mixing"](spark, docs, DATA).collect())
    assert {i: copies[i] for i in taken} == {i: c if size else 1 for i, (c, size) in taken.items()}
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in stage["sentencepiece_encoding"](spark, docs, DATA).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        assert list(r.ids) == p.encode(text)


def test_run_gives_the_stages_result(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, None), (None, "testo senza id", "it", "s", 3), (2, "", "", "", 0), (2, "", "", "", 0), (3, "x " * 5000, "en", "s", 10000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_row": F.lit("a"), "i": F.lit(1), "t": F.lit(2), "key": F.lit(3), "size": F.lit(4), "component_id": F.lit(5)})
    out = stage(spark, docs, DATA)
    wanted = [c for c in docs.columns if name != "sentencepiece_encoding" or c != "text"]
    assert [c for c in out.columns if c not in ("ids", "decoded_sha256")] == wanted
    out.collect()
    assert stage(spark, docs.limit(0), DATA).count() == 0
