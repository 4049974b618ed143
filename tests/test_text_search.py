import sqlite3

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridquill.functions import cells as C
from gridquill.functions import text as X
from gridquill.operators import catalog, enrich, grams, ivf, lexical, search

DOCS = [(1, "alpha beta gamma"), (2, "alpha alpha delta"), (3, "beta DBL-179 eps"), (4, "zeta eta theta iota"), (5, "kappa alpha"), (6, "Café x"), (7, "mu nu"), (8, "xi omicron")]


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.fixture(scope="module")
def post(spark):
    return search.postings(spark.createDataFrame(DOCS, "id long, text string"), "id", "text").cache()


def bm25(spark, post, question):
    q = spark.createDataFrame([(1, question)], "query_id long, question string")
    return {r["ref_id"]: round(r["score"], 6) for r in search.bm25(post, q).collect()}


@pytest.mark.parametrize(
    ("question", "want"),
    [("alpha", {2: 0.605986, 5: 0.508746, 1: 0.435778}), ("alpha beta", {1: 1.357029}), ("DBL-179", {3: 1.357087}), ("CAFÉ", {6: 1.811553}), ("cafe", {}), ("-", {}), ("- alpha", {2: 0.605986, 5: 0.508746, 1: 0.435778})],
)
def test_bm25(spark, post, question, want):
    assert bm25(spark, post, question) == want


def test_bm25_agrees_with_sqlite(spark, post):
    try:
        con = sqlite3.connect(":memory:")
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 0')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", DOCS)
    for q in ("alpha", "beta", "alpha delta", "eps"):
        match = " ".join(f'"{w}"' for w in q.split())
        want = {i: round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert bm25(spark, post, q) == want


def test_tokens_and_identifiers(spark):
    assert value(spark, X.tokens, "DBL-179の対応 test") == ["DBL-179", "の", "対", "応", "test"]
    assert value(spark, X.query_string, "DBL-179の対応 test") == '"DBL-179" "の" "対" "応" "test"'
    assert value(spark, X.identifiers, "DBL-179の対応 KAIZEN-2635 AB-1 BUDGED_COST_1, DBL179") == ["KAIZEN-2635", "BUDGED_COST_1", "DBL179"]
    assert value(spark, X.tokens, "") == []


def test_section_parse_and_confidence(spark):
    t = "noise\nTECHNICAL:\nt1\nBUSINESS：\nb1\nKEYWORDS\nk1 k2\nEND"
    assert [value(spark, lambda c, k=k: X.labelled_section(c, k), t) for k in ("TECHNICAL", "BUSINESS", "KEYWORDS")] == ["t1", "b1", "k1 k2"]
    assert value(spark, lambda c: X.labelled_section(c, "BUSINESS"), "no labels") == ""
    assert value(spark, lambda c: X.labelled_section(c, "TECHNICAL"), "TECHNICAL\na\nTECHNICAL\nb\nEND\nBUSINESS\nc") == "b"
    assert value(spark, lambda c: X.labelled_section(c, "TECHNICAL"), "TECHNICAL\na\nEND\nTECHNICAL\nb") == "a"
    for answer, want in (("答え\n__CONFIDENCE__: 8", ("答え", 8)), ("plain", ("plain", None)), ("x __CONFIDENCE__：0", ("x", 0))):
        r = spark.createDataFrame([(answer,)], "t string").select(X.answer_body(F.col("t")), X.confidence(F.col("t"))).first()
        assert tuple(r) == want


def test_exact_recall_like_and_literal(spark):
    c = spark.createDataFrame([(1, "budgedXcost_1"), (2, "BUDGED_COST_1"), (3, "zz")], "id long, text string")
    q = spark.createDataFrame([(1, "find BUDGED_COST_1"), (2, "nothing here")], "query_id long, question string")
    assert rows(search.exact_recall(c, q), "query_id", "chunk_id") == [(1, 1), (1, 2)]
    assert rows(search.exact_recall(c, q, literal=True), "query_id", "chunk_id") == [(1, 2)]


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i) for i, c in enumerate(ids)], "query_id long, chunk_id long, rank int")


def test_fusion_order_and_ties(spark):
    out = search.fuse({"vec_chunk": ranked(spark, [1, 2]), "vec_summary": ranked(spark, [2]), "fts": ranked(spark, [3, 1]), "exact": ranked(spark, [])}).orderBy("rank").collect()
    assert [(r["chunk_id"], r["sources"]) for r in out] == [(1, "vec_chunk,fts"), (2, "vec_chunk,vec_summary"), (3, "fts")]
    assert out[0]["score"] == 1 / 60 + 1 / 61


def test_scoped_knn_post_and_pre(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 6)], "chunk_id long, embedding array<float>")
    c = spark.createDataFrame([(i, 9 if i <= 3 else 8, i) for i in range(1, 6)], "id long, folder_id long, document_id long")
    q = spark.createDataFrame([(1, [1.0, 0.0], 8, None)], "query_id long, embedding array<float>, folder_id long, document_id long")
    assert search.chunk_recall(v, q, c, 3).count() == 0
    assert rows(search.chunk_recall(v, q, c, 3, "pre"), "chunk_id") == [(4,), (5,)]


def test_summary_recall_takes_the_best(spark):
    s = spark.createDataFrame([(1, 7, [1.0, 0.1]), (2, 7, [1.0, 0.2]), (3, 3, [1.0, 0.5]), (4, 5, [0.0, 1.0])], "id long, chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["chunk_id"] for r in search.summary_recall(s, q, k=3).orderBy("rank").collect()] == [7, 3]


def test_ivf_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("ref_id"), "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = set(rows(search.knn(v, q, 10), "query_id", "ref_id"))
    got = set(rows(search.ivf_knn(ivf.build(v, 8), q, 10, probes=6), "query_id", "ref_id"))
    assert len(want & got) >= 0.9 * len(want)


def test_context_without_hits(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    none = spark.createDataFrame([], "query_id long, chunk_id long, filename string, sheet_name string, score double, sources string, rank int, text string")
    assert search.context(none, q, "empty").first()["context"] == "empty"
    with pytest.raises(ValueError):
        search.hybrid_search(q, q, q, q, q, q, q, limit=0)


def test_cascade_leaves_no_orphans(spark):
    one = lambda rows_, ddl: spark.createDataFrame(rows_, ddl)
    t = {
        "folder": one([(1,), (2,)], "id long"), "document": one([(1, 1), (2, 1), (3, 2)], "id long, folder_id long"),
        "chunk": one([(i, (i + 1) // 2) for i in range(1, 7)], "id long, document_id long"), "chunk_summary": one([(10 + i, i) for i in range(1, 7)], "id long, chunk_id long"),
        "chunk_vec": one([(i,) for i in range(1, 7)], "chunk_id long"), "summary_vec": one([(10 + i,) for i in range(1, 7)], "summary_id long"),
        "postings_chunk": one([(i,) for i in range(1, 7)], "ref_id long"), "postings_summary": one([(10 + i,) for i in range(1, 7)], "ref_id long"),
    }
    out = catalog.cascade_delete(t, "folder", one([(1,)], "id long"))
    assert {k: v.count() for k, v in out.items()} == {"folder": 1, "document": 1, "chunk": 2, "chunk_summary": 2, "chunk_vec": 2, "summary_vec": 2, "postings_chunk": 2, "postings_summary": 2}
    assert catalog.cascade_delete(t, "document", one([(3,)], "id long"))["folder"].count() == 2


def test_image_digest(spark):
    im = spark.createDataFrame([(bytearray(b"a"), "PNG"), (bytearray(b"a"), "png"), (bytearray(b"b"), "tif")], "bytes binary, format string")
    got = rows(catalog.distinct_images(im), "digest", "format")
    assert len(got) == 2 and all(len(d) == 12 and f == "png" for d, f in got)


def test_enrich_gate_and_model(spark):
    c = spark.createDataFrame([(1, " " * 5 + "x" * 79, True), (2, "x" * 80, True), (3, "x" * 90, False)], "id long, text string, enrich_eligible boolean")
    assert rows(enrich.enrich_gate(c), "id") == [(2,)]
    got = enrich.enrich(c, lambda t: "TECHNICAL\nt\nBUSINESS\nb\nKEYWORDS\nk\nEND").first()
    assert (got["technical"], got["business"], got["keywords"]) == ("t", "b", "k")
    e = c.select(enrich.embed(F.col("text")).alias("e")).first()["e"]
    assert len(e) == 64 and abs(sum(x * x for x in e) - 1) < 1e-5


def test_cell_functions(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (16384,)], "n int")
    assert [r[0] for r in df.select(C.column_letter(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    df = spark.createDataFrame([("FFFF0000", None, None), ("00000000", None, None), (None, 2, None), (None, None, "4472c4"), (None, 99, None)], "rgb string, i int, theme string")
    assert [r[0] for r in df.select(C.resolve_color(F.col("rgb"), F.col("i"), F.col("theme"))).collect()] == ["#FF0000", None, "#FF0000", "#4472C4", None]
    assert value(spark, lambda c: X.tolerant_string(F.parse_json(c)), '[{"name":"a"},"b",{"zz":1}]') == 'a, b, {"zz":1}'
    assert value(spark, X.safe_file_name, "a/b 画面.x") == "a_b_画面.x"


def test_screen_description(spark):
    d = '{"screen_title":{"text":"T"},"layout":"two panes","regions":[{"name":"list","controls":["a",{"name":"b"}]},"plain",{"controls":"one"}],"annotations":[{"marker":"1","description":"d"},"x"],"notes":["n","m"]}'
    show = lambda c: X.render_description(X.json_or_empty(c))
    assert value(spark, show, d).split("\n") == ["**画面标题**: T", "**布局**: two panes", "**区块与控件**:", "- list", "  - a", "  - b", "- plain", "- (unnamed)", "  - one", "**标注**:", "- 1 @ ? — d", "- x", "**备注**: n, m"]
    assert value(spark, show, "not json") == value(spark, show, "[]") == "_(画面描述生成失败)_"


def test_pluggable_tokenizer_and_cross_encoder(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, None)], "id long, text string")
    post = search.postings(df, "id", "text", tokenizer=lambda c: F.split(F.upper(c), " "))
    assert sorted((r["ref_id"], r["term"], r["pos"]) for r in post.collect()) == [(1, "AB", 0), (1, "CD", 1), (2, "", 0)]
    hits = spark.createDataFrame([(1, 1, "aa", 0.5, 0), (1, 2, "aaaa", 0.4, 1), (1, 3, None, 0.3, 2)], "query_id long, chunk_id long, text string, score double, rank long")
    q = spark.createDataFrame([(1, "a")], "query_id long, question string")
    scorer = search.cross_encoder(lambda: lambda pairs: [float(t.count(x)) for x, t in pairs])
    assert [r["chunk_id"] for r in search.rerank(hits, q, scorer).orderBy("rank").collect()] == [2, 1, 3]


def test_texts_of_chunks_are_not_shuffled_for_the_hits(spark):
    hits = spark.createDataFrame([(1, 2, 0.5, 0), (1, 9, 0.4, 1), (2, 2, 0.5, 0)], "query_id long, chunk_id long, score double, rank int")
    chunks = spark.createDataFrame([(i, i, i, t) for i, t in DOCS], "id long, sheet_id long, document_id long, text string")
    sheets, documents = spark.createDataFrame([(2, "s")], "sheet_id long, name string"), spark.createDataFrame([(2, "f")], "id long, filename string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        got = search.hydrate(hits, chunks, sheets, documents)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk_id" not in plan and "hashpartitioning(sheet_id" in plan
        assert sorted((r["query_id"], r["chunk_id"], r["text"], r["filename"]) for r in got.collect()) == [(1, 2, DOCS[1][1], "f"), (2, 2, DOCS[1][1], "f")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
