"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import components as link_components
from strataloom.llm import line_dedup, mixing, near_dup, quality_classifier, quality_rules, sentencepiece, suffix_dedup, token_files
from strataloom.llm.shared import written
from strataloom.llm.tokenizer_files import BYTE_BPE, PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    base = " ".join(rng.choice(vocabulary) for _ in range(120))
    shared = "Questa riga comune sta in molti documenti diversi, davvero."
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = base.split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        elif kind == 1:
            text = base
        elif kind == 2:
            text = "\n".join([" ".join(rng.choice(vocabulary) for _ in range(20)), f"  {shared.upper() if i % 4 else shared}\t", "x"])
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) + rng.choice(["", ".", " !!! ###", "\n\n"])
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    long = " ".join(rng.choice(vocabulary) for _ in range(40_000))
    return [*out, (1000, None, None, None, None), (1001, "", "", "", 0), (1002, " \n\t ", "en", "s1", 4), (1003, long, "en", "s2", len(long)), (1004, "a" * 300, "en", "s2", 300), (1005, "uno due", "en", None, 7), (1006, shared, "en", "s3", 5)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


# -- suffix dedup


def cut(text, spans):
    kept, at = b"", 0
    for s, e in spans:
        kept, at = kept + text[at:s], e
    return kept + text[at:]


def test_suffix_dedup(docs, rows, empty):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    expected = suffix_dedup.brute_force(texts)
    got = {r.doc_id: r for r in suffix_dedup.digest(docs).collect()}
    assert set(got) == set(texts)
    for i, spans in expected.items():
        kept = cut(texts[i], spans)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(texts[i]), len(texts[i]) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_repeated_and_null_ids(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(90))
    rows = [(1, text, "a"), (1, text, "b"), (1, "zz" + text, "c"), (2, "x" + text, "d"), (None, text, "e"), (3, None, "f")]
    got = {r._row: r for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()}
    assert [bool(got[k]._spans) for k in "abcdef"] == [False, False, False, True, False, False]
    assert bytes(got["d"]._kept) == b"x"


def test_suffix_dedup_gives_a_row_for_a_row(spark):
    text, other = "".join(chr(97 + k * k % 23) for k in range(90)), "".join(chr(97 + k * k % 19) for k in range(90))
    rows = [(1, text, "a"), (1, text, "b"), (2, "x" + text, "c"), (2, other, "d"), (2, other, "e"), (3, other, "f"), (3, other, "g"), (None, None, "h"), (4, None, "i"), (4, text, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").withColumns({"_kept": F.lit("mine"), "_k": F.lit(3), "i": F.lit(4), "t": F.lit(5)})
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == ["doc_id", "text", "name", "_k", "i", "t", "_kept", "_n_bytes", "_spans"]
    got = out.collect()
    assert sorted(r.name for r in got) == list("abcdefghij")
    assert {r.name: bytes(r._kept or b"") for r in got} == {"a": text.encode(), "b": text.encode(), "c": b"x", "d": other.encode(), "e": other.encode(), "f": b"", "g": b"", "h": b"", "i": b"", "j": b""}


@pytest.mark.parametrize(("held", "met"), [(1 << 12, 3_000_000), (24 << 20, 50), (1 << 10, 7)])
def test_suffix_dedup_in_small_steps(spark, docs, rows, held, met, monkeypatch):
    """Entries leave their tasks early and meet in many folds."""
    for batches, kinds in ((suffix_dedup._anchor_entries(3, 50), "ikt"),):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        monkeypatch.setattr(suffix_dedup, "MET", met)
        import pyarrow as pa

        texts = {r[0]: (r[1] or "").encode() for r in rows if len((r[1] or "").encode()) >= 50}
        table = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(list(texts.values()), pa.binary())], list(kinds))

        def through(batch, step):
            return [b for b in step(iter(batch)) if b.num_rows]

        found = through(through([table], batches), suffix_dedup._settle(3, 50, True))
        rows_of = [r for b in through(found, suffix_dedup._by_document()) for r in b.to_pylist()]
        opened = {r["i"]: r["open"] for r in rows_of if r["open"]}
        again = pa.RecordBatch.from_arrays([pa.array(list(opened), pa.int64()), pa.array([0] * len(opened), pa.int32()), pa.array([texts[i] for i in opened], pa.binary()), pa.array(list(opened.values()), pa.binary())], ["i", "k", "t", "open"])
        more = through(through([again], suffix_dedup._window_entries(3, 50)), suffix_dedup._settle(3, 50, False)) if opened else []
        rows_of += [r for b in through(more, suffix_dedup._by_document()) for r in b.to_pylist()]
        spans = defaultdict(list)
        for r in rows_of:
            if r["spans"]:
                start, end = suffix_dedup.unpack_columns(r["spans"], "ii")
                spans[r["i"]] += list(zip(start.tolist(), end.tolist(), strict=True))
        for i, expected in suffix_dedup.brute_force(texts).items():
            covered = {x for s, e in spans[i] for x in range(s, e)}
            assert covered == {x for s, e in expected for x in range(s, e)}, i


def test_buckets_of_equal_strings_are_equal():
    data = np.frombuffer(b"abcabdabcabdabcabx" * 9, dtype=np.uint8)
    for length in (4, 7, 50):
        own = suffix_dedup.Buckets(data, suffix_dedup._SECOND_CODE, length)
        at = np.arange(len(data) - length + 1)
        half = own.halves()
        assert (half[at] == own.half_at(at)).all()
        full, raw = own.full_at(at), data.tobytes()
        assert (full == own.full(half[at], half[at + length - own.half])).all()
        assert len(set(full.tolist())) == len({raw[i : i + length] for i in at.tolist()})


def test_packed_columns_round_trip():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**62), 2**62, 50), rng.integers(0, 2**64, 50, dtype=np.uint64)
    x, y, z = suffix_dedup.unpack_columns(suffix_dedup.pack_columns(a, b, np.full(50, 7)), "iui")
    assert (x == a).all() and (y == b).all() and (z == 7).all()


# -- near duplicates


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, size, percent=80):
    sets = {r[0]: shingles(r[1], size) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("members", [1024, 3])
def test_near_duplicates(docs, rows, size, members, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.classes_of(docs, size=size).collect()}
    assert got == components(rows, size)


def test_near_duplicates_without_rows_and_ids(spark, empty):
    assert near_dup.classes_of(empty).count() == 0
    rows = [(None, "uno due tre quattro cinque sei"), (4, "uno due tre quattro cinque sei"), (3, "uno due tre quattro cinque sei"), (3, "uno due tre quattro cinque sei")]
    got = near_dup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, 3), (3, 3), (3, 3), (4, 3)]


def test_boilerplate_makes_no_large_family(spark):
    rng = np.random.default_rng(8)
    common = [f"b{k}" for k in range(70)]  # 67 shingles of about 247 in either text: a similarity near 0.16, and twice that for 120
    for shared, n in ((common, 400), ([f"b{k}" for k in range(120)], 400)):
        rows = [(i, " ".join([*shared, *(f"w{x}" for x in rng.integers(0, 10**6, 180))])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        profile = near_dup.profiles(docs, 4, 24)
        first = near_dup.star_candidates(profile.select("doc_id", "sig"), 12, 2)
        again = near_dup.second_stars(docs, first, 4, 24)
        assert near_dup.components(again).groupBy("root").count().where("count > 8").count() == 0


@pytest.mark.parametrize("block", [1 << 19, 3])
def test_components_of_links(spark, block, monkeypatch):
    monkeypatch.setattr(link_components, "LINKS", block)  # 3: every part of the table is a block of its own
    rng = np.random.default_rng(3)
    ids = rng.permutation(10**6)[:600] - 300_000
    chain, hub, some = ids[:40], ids[40:140], rng.choice(ids[140:], (260, 2))
    links = [*zip(chain[:-1], chain[1:]), *((hub[0], x) for x in hub), *some, *some[:20, ::-1]]
    rows = [(int(a), int(b)) for a, b in links] + [(7, None), (None, 8), (None, None)]
    table = written(spark.createDataFrame(rows, "a long, b long").repartition(6), "test_links")
    parent = {x: x for r in rows for x in r if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None and b is not None and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    linked = {x for a, b in rows if a is not None and b is not None and a != b for x in (a, b)}
    got = [tuple(r) for r in link_components.components(table).select("node", "root").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in linked)
    assert not link_components.components(table.where("a IS NULL")).take(1)


def test_second_banding_finds_near_copies():
    rng = np.random.default_rng(9)
    missed, tries = 0, 400
    for _ in range(tries):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.sort(np.concatenate((both, rng.integers(0, 2**63, 20, dtype=np.uint64)))) for _ in range(2))  # 160 of 200
        keys = near_dup.table_keys(near_dup.signatures([a, b], 216, 24), *near_dup.SECOND)
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 4


def test_linked_joins_what_similar_pairs_join():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]

    def groups(pairs):
        root = list(range(40))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return sorted(sorted(k for k in range(40) if root[k] == r) for r in set(root))

    near = [(i, j) for i in range(40) for j in range(i) if 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 48 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
    assert groups(near_dup._linked(sets, np.arange(40), np.ones(40, dtype=bool), 48)) == groups(near)


# -- tokens


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(BYTE_BPE), 0
    token_files.write_token_files(docs.select("doc_id", "text"), str(tmp_path / "t"), BYTE_BPE, page_bytes=1 << 12)
    got = {r.doc_id: r for r in token_files.token_digest(spark, str(tmp_path / "t")).collect()}
    read = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    for i, text, *_ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert list(read[i].ids) == ids and read[i].start == at
        at += len(ids)
    token_files.write_token_files(empty, str(tmp_path / "e"), BYTE_BPE)
    assert token_files.token_digest(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", " lead", "trail ", "a  b", "a \nb", "a\n b", "it's, we'll.", "a\x1cb \x1c c", "parola, parola. parola.. d'oro, x, 3a, ab. ab", "ab, <|endoftext|>, z", "　a 　", "1,000 .5", "x ,.", "é́ à."])
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    got, before = token_files.encoder(BYTE_BPE).encode([b"", text.encode(), b"after it"])
    assert got[: before[2]].tolist() == ids and before[1] == 0


def test_encoder_forgets_and_stays_right(rows):
    small, whole = token_files.Encoder(BYTE_BPE, most=20), token_files.Encoder(BYTE_BPE)
    for r in rows * 2:
        (a, b), (c, d) = small.encode([(r[1] or "").encode()]), whole.encode([(r[1] or "").encode()])
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_bytes_that_are_no_text_do_not_stop_the_encoder():
    got, _ = token_files.encoder(BYTE_BPE).encode([b"ab \xff\xfe cd \xe2\x82"])
    assert got.tolist() == token_files.encoder(BYTE_BPE).encode(["ab \ufffd\ufffd cd \ufffd".encode()])[0].tolist()


def test_ends_of_ranges():
    data = np.frombuffer(b"abcdefghijklmnop", dtype=np.uint8)
    s, e = np.array([0, 0, 3, 15, 5, 0]), np.array([16, 8, 5, 16, 5, 9])
    low, high = token_files._ends_of(data, s, e)
    words = [bytes(data[i:j]) for i, j in zip(s, e, strict=True)]
    assert [x.tobytes() for x in high] == [w[-8:].ljust(8, b"\0") for w in words]
    assert [x.tobytes() for x in low] == [w[:8].rjust(8, b"\0") for w in words]


@pytest.mark.parametrize("n", [0, 1, 61, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("high", [1, 30, 2**16, 2**32 - 1])
def test_packing_round_trip(n, high):
    rng = np.random.default_rng(n + high)
    ids = rng.integers(0, high + 1, n).astype(np.uint32)
    if n > 10:
        ids[rng.integers(0, n, n // 9)] = rng.integers(0, 2**32, n // 9)
    packed, offsets, escapes = token_files.pack(ids)
    assert (token_files.unpack(packed, escapes) == ids).all() and offsets[-1] == len(packed)


def test_damaged_page_is_noticed():
    page = token_files.to_page(np.array([1]), np.array([0, 3]), np.array([5, 6, 7], dtype=np.uint32))
    with pytest.raises(ValueError):
        token_files.from_page(b"xxxx" + page[4:])


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece as library

    p, v = library.SentencePieceProcessor(model_file=PIECES), sentencepiece.load(PIECES)
    extra = spark.createDataFrame([(2000, "日本 😀▁x  y \n z", "en", "s", 1), (2001, "q" * 200, "en", "s", 1)], DOCS)
    for most in (10, 1_000_000):
        got = {r.doc_id: list(r.ids) for r in sentencepiece.encode(docs.union(extra), v, most).collect()}
        for i, text, *_ in [*rows, *extra.collect()]:
            assert got[i] == p.encode(text or ""), i
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    odd = spark.createDataFrame([(None, "zero nulla", 1), (None, "altro niente", 2), (5, "uno", 3), (5, "due", 4), (5, None, 5)], "doc_id long, text string, ids int")
    for most in (1, 1_000_000):
        out = sentencepiece.encode(odd, v, most, decoded=True)
        assert out.columns == ["doc_id", "ids", "decoded"] and sorted(r.decoded for r in out.collect()) == ["", "altro niente", "due", "uno", "zero nulla"]
    small = sentencepiece.common_units(sentencepiece.unit_table(docs.select(F.col("text").alias("t")), v, sentencepiece.splitter(v)), 1_000_000, 2000)
    assert small.least > 0 and 14 * (len(small.keys) - 1) + 4 * len(small.flat) <= 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    back = sentencepiece.decode(sentencepiece.encode(docs, v), v).select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in back} == {r[0]: p.decode(p.encode(r[1] or "")) for r in rows}
    assert sentencepiece.encode(empty, v).count() == 0


def test_common_units_take_little_more_of_the_driver_than_their_size(spark):
    import tracemalloc

    table = spark.range(0, 150_000, numPartitions=4).select(F.xxhash64("id").alias("h"), (F.col("id") % 5 + 1).alias("freq"), F.expr("transform(sequence(1, 1 + CAST(id % 13 AS int)), x -> CAST(id * x % 32000 AS int))").alias("ids"))
    sentencepiece.common_units(table.limit(10), 10)  # what is imported at the first call doesn't count
    for most, least in ((150_000, 0), (100_000, 3)):
        tracemalloc.start()
        got = sentencepiece.common_units(table, most)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        expected = {r.h: r.ids for r in table.where(F.col("freq") >= least).collect()}
        assert got.least == least and len(got.keys) - 1 == len(expected)
        place = got.find(np.array(list(expected), dtype=np.int64).view(np.uint64))
        assert [got.flat[got.offsets[k] : got.offsets[k + 1]].tolist() for k in place] == list(expected.values()) and (place >= 0).all()
        assert peak < 2 * sum(x.nbytes for x in (got.keys, got.first, got.offsets, got.flat))


def test_viterbi_fold_equals_a_search(spark):
    scores = {"▁": -2.0, "a": -1.5, "b": -1.0, "c": -3.0, "ab": -1.2, "▁a": -2.5, "bc": -1.1, "▁ab": -5.0}
    v = sentencepiece.Vocabulary("unigram", tuple(scores), tuple(scores.values()), frozenset(range(len(scores))), tuple(range(256)), 0)
    units = ["▁abc", "▁abcab", "▁", "▁cab", "▁xa", "ab"]
    net = sentencepiece.lattice(spark.createDataFrame([(u, 1) for u in units], "unit string, freq long"), sentencepiece.piece_table(spark, v), v.longest)
    for r in net.select("unit", sentencepiece.fold_viterbi(v).alias("m")).collect():
        n, best = len(r.unit), {0: (0.0, 1)}
        for e in range(1, n + 1):
            best[e] = max((best[s][0] + scores.get(r.unit[s:e], min(scores.values()) - 10 if e - s == 1 else -1e9), best[s][1] | 1 << e) for s in range(e))
        assert r.m == best[n][1], r.unit


# -- rules, lines, mixing, classifier


def test_quality_rules(docs, rows, empty):
    got = {r.doc_id: r for r in quality_rules.digest(docs).collect()}
    for i, text, *_ in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        windows = defaultdict(list)
        for k in range(len(w) - 4):
            windows[tuple(w[k : k + 5])].append(k)
        repeat = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == expected
        base = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        assert got[i].base_failed is base and (not base or got[i].kept is False)
    assert quality_rules.digest(empty).count() == 0


def test_ablations_equal_counts(docs):
    ledger = quality_rules.ledger(docs)
    rows = [r.fail_bits for r in ledger.collect()]
    for r in quality_rules.ablations(ledger, "web-2").collect():
        bit = next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only) == (sum(b >> bit & 1 for b in rows), sum(b == 1 << bit for b in rows))


@pytest.mark.parametrize("bits", [20, 27])
def test_line_dedup(docs, rows, empty, bits):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, bloom_bits=bits).collect()}
    assert any(len(h) >= 5 for h in holders.values())
    assert any(r._n_dropped for r in got.values())
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and i < max(holders[key(x)]))]
        assert (got[i]._n_lines, got[i]._n_dropped, got[i]._text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.digest(empty).count() == 0


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    line = "una riga abbastanza lunga da contare come comune"
    rows = [(1, f"{line}\nuno\n{line.upper()}"), (1, f"altro\n {line}"), (1, f"{line}\nuno\n{line.upper()}"), *((k, line) for k in range(2, 6)), (None, line), (7, None), (8, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_text", "_lost", "_kept", "i", "h", "at", "_edges")})
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "_lost", "_kept", "i", "h", "at", "_edges", "_n_lines", "_n_dropped", "_text"]
    got = sorted((r.doc_id or 0, r._n_lines, r._n_dropped, r._text) for r in out.collect())
    assert got == sorted([(1, 3, 2, "uno"), (1, 2, 1, "altro"), (1, 3, 2, "uno"), (2, 1, 1, ""), (3, 1, 1, ""), (4, 1, 1, ""), (5, 1, 0, line), (0, 1, 0, line), (7, 1, 0, ""), (8, 2, 0, "\n")])


def test_mixing_of_repeated_rows_meets_the_target(spark):
    rows = [(1, "uno due tre", "a")] * 400 + [(k, "parola " * 8, "b") for k in range(2, 500)] + [(None, "x y", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.decisions(docs).collect()
    assert len(got) == len(rows)
    for source, largest in (("a", 3), ("b", 8)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= largest and max(r.copies for r in mine) <= 2
    copies = Counter(r.copies for r in got if r.source == "a")
    assert max(copies) - min(copies) <= 1
    mixed = Counter(r.source for r in mixing.mix(docs.withColumn("extra", F.lit("x"))).collect())
    assert mixed == Counter({s: sum(r.copies for r in got if r.source == s) for s in "ab"})
    again = mixing.decisions(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)


def test_mixing(spark, docs, rows, empty):
    got = mixing.decisions(docs.select("doc_id", "source", "text")).collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s] + 1e-9}
        if not over:
            target.update(share)
            break
        target.update({s: 2.0 * total[s] for s in over})
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[r.source]) and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max((size[r[0]] for r in rows if r[3] == s), default=0)
    again = mixing.decisions(docs.repartition(5).select("doc_id", "source", "text")).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    assert mixing.digest(empty).count() == 0


def test_mix_repeats_rows_with_clashing_columns(docs):
    wide = docs.withColumns({"size": F.lit("x"), "taken": F.lit(1), "_key": F.lit(2), "n": F.lit(3)})
    out = mixing.mix(wide)
    assert out.columns == wide.columns
    copies = Counter(r.doc_id for r in out.collect())
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.decisions(docs.select("doc_id", "source", "text")).collect()}
    assert all(copies[i] == (t // s if s else 1) for i, (t, s) in taken.items())


def test_classifier_learns_a_rule(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        good = i % 2
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) + ("" if good else "###") for _ in range(rng.randint(20, 60)))
        docs.append((i, text, "en", "s", 1))
        labels.append((i, good, 0))
    d = spark.createDataFrame(docs, DOCS)
    model = quality_classifier.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality_classifier.score(d, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert held and all(got[i].predicted == i % 2 for i in held) and all(0 <= r.score <= 1 for r in got.values())
    wide = d.withColumns({"n_words": F.lit(9), "_row": F.lit(1)})
    kept = quality_classifier.keep(wide, model)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_counts_equal_brute_force(docs, rows):
    from strataloom.llm.quality_stats import with_counts

    got = {r.doc_id: r.asDict() for r in with_counts(docs).collect()}
    ascii_ = lambda lo, hi: {chr(c) for c in range(lo, hi)}
    punct = ascii_(33, 48) | ascii_(58, 65) | ascii_(91, 97) | ascii_(123, 127)
    for i, text, *_ in rows:
        t, w = text or "", words(text)
        counts = Counter(w)
        expected = {
            "n_lines": t.count("\n") + 1, "n_upper": sum(c in ascii_(65, 91) for c in t), "n_digits": sum(c in ascii_(48, 58) for c in t), "n_punct": sum(c in punct for c in t), "n_bang": t.count("!"), "n_stops": t.count("."),
            "n_high": sum(len(c.encode()) for c in t if ord(c) > 127), "n_distinct": len(counts), "n_points": len(t), "top_word": max(counts.values(), default=0), "n_short": sum(len(x) <= 2 for x in w), "n_long": sum(len(x) >= 14 for x in w),
            "n_caps_words": sum(x[0] in ascii_(65, 91) for x in w),
        }
        assert {k: got[i][k] for k in expected} == expected, i


def test_repeated_ids_teach_once(spark):
    docs = [(k, " ".join(["parola" + "#" * (k % 2)] * (20 + j))) for k in range(200) for j in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(d, labels) == quality_classifier.train(d.where("length(text) < 100000").groupBy("doc_id").agg(F.min("text").alias("text")), labels)


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, none)
    assert {r.score for r in quality_classifier.score(docs, model).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


def test_columns_equal_the_model_on_rows(spark, docs):
    x = quality_classifier.features(docs).orderBy("doc_id").toPandas()[list(quality_classifier.FEATURES)].to_numpy()
    model = quality_classifier.fit_rows(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    got = [r.score for r in quality_classifier.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, model.score_rows(x))
