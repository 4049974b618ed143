"""The stored indexes against plain loops: BM25 by blocks, LIKE by grams, vectors by lists."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridquill.functions import text as X
from gridquill.operators import grams, ivf, lexical, search
from gridquill.plans import catalogue


def _bm25(docs, question, limit, scope=None):
    """Best ``limit`` documents, phrases of any length, all of which must occur."""
    words = {i: [w for w in re.split(r"[\W_]+", t.lower()) if w] for i, t in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    phrases = [[w for w in re.split(r"[\W_]+", p.lower()) if w] for p in question.split()]
    phrases = [p for p in phrases if p]
    tf = [{i: n for i, w in words.items() if (n := sum(w[k : k + len(p)] == p for k in range(len(w))))} for p in phrases]
    out = []
    for i, w in words.items():
        if tf and all(i in t for t in tf) and (scope is None or i in scope):
            idf = [max(math.log((len(words) - len(t) + 0.5) / (len(t) + 0.5)), 1e-6) for t in tf]
            out.append((-round(sum(x * t[i] * 2.2 / (t[i] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for x, t in zip(idf, tf, strict=True)), 9), i))
    return [i for _, i in sorted(out)[:limit]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(150)]
    docs = {i: " ".join(rng.choices(common + rare, weights=[30, 20, 10] + [1] * 150, k=rng.choice([3, 10, 40, 200]))) for i in range(600)}
    frame = spark.createDataFrame([(i, i % 7, t) for i, t in docs.items()], "id long, folder_id long, text string").withColumn("document_id", F.col("id"))
    return docs, frame.cache()


@pytest.mark.parametrize(("first", "scoped"), [(1, True), (16, False)])
def test_top_rows_by_blocks(spark, corpus, first, scoped, monkeypatch):
    docs, frame = corpus
    index = lexical.build_index(search.postings(frame, "id", "text"), block_rows=8)
    assert index.blocks.select("block").distinct().count() > 40
    monkeypatch.setattr(lexical.bm25_top, "__defaults__", (first, 20))
    questions = ["the", "the of", "the of and", "w3", "the w5 w9", "w1 w2", "the-of w7", "and-the", "nowhere the", "-", "of the the"]
    q = spark.createDataFrame([(i, t, i % 7 if scoped else None, None) for i, t in enumerate(questions)], "query_id long, question string, folder_id long, document_id long")
    got = {}
    for r in search.fts_recall(index, q, frame, limit=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for i, t in enumerate(questions):
        scope = {x for x in docs if x % 7 == i % 7} if scoped else None
        assert [v for _, v in sorted(got.get(i, {}).items())] == _bm25(docs, t, 5, scope), t


def test_blocks_leave_rows_out_and_their_bounds_hold(spark, corpus):
    docs, frame = corpus
    index = lexical.build_index(search.postings(frame, "id", "text"), block_rows=8)
    seen = []
    cut = lambda s: seen.append(s) or search.top(s.withColumnRenamed("ref_id", "chunk_id"), 4)
    q = spark.createDataFrame([(1, "the of")], "query_id long, question string")
    kept = lexical.bm25_top(index, q, 4, cut, 2, 20)
    every = search.bm25(index, q)
    assert 4 <= kept.count() < 0.9 * every.count()
    assert kept.orderBy(F.desc("score")).limit(4).collect()[3]["score"] == every.orderBy(F.desc("score")).limit(4).collect()[3]["score"]
    w = index.post.withColumn("w", lexical._weight(F.col("tf"), F.col("dl"), index.avg_len))
    assert w.join(index.blocks, ["term", "block"]).where("w > best").count() == 0


def test_any_match_and_flat_index_agree(spark, corpus):
    _, frame = corpus
    post = search.postings(frame, "id", "text")
    q = spark.createDataFrame([(1, "w1 w2-w3 the-of"), (2, "w4 w5")], "query_id long, question string")
    index = lexical.build_index(post, 8)
    for match in ("any",):
        a, b = (sorted((r["query_id"], r["ref_id"], round(r["score"], 9)) for r in search.bm25(p, q, match).collect()) for p in (post, index))
        assert a == b
    assert rows(search.phrase_hits(post, q), "query_id", "phrase_no", "ref_id", "tf") == rows(search.phrase_hits(index, q), "query_id", "phrase_no", "ref_id", "tf")


@pytest.mark.parametrize("scoped", [False, True])
def test_a_scan_answers_like_plain_loops(spark, corpus, scoped, monkeypatch):
    docs, frame = corpus
    monkeypatch.setattr(lexical, "SCAN_TERMS", 700)
    questions = ["the", "the of", "the of and", "w3", "the w5 w9", "w1 w2", "the-of w7", "and-the", "nowhere the", "-", "of the the", "the-the-of", "the-of the-of-and"]
    q = spark.createDataFrame([(i, t, i % 7 if scoped else None, None) for i, t in enumerate(questions)], "query_id long, question string, folder_id long, document_id long")
    more = spark.createDataFrame([(1000, None), (1001, ""), (1002, "- . -")], "id long, text string")
    found = search.scan(search.term_lists(frame.select("id", "text").unionByName(more), "id", "text"), q)
    assert found.n_rows == len(docs)
    got = {}
    for r in search.fts_recall(found, q, frame, limit=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for i, t in enumerate(questions):
        scope = {x for x in docs if x % 7 == i % 7} if scoped else None
        assert [v for _, v in sorted(got.get(i, {}).items())] == _bm25(docs, t, 5, scope), t
    index = lexical.build_index(search.postings(frame, "id", "text"), 8)
    assert rows(search.phrase_hits(found, q), "query_id", "phrase_no", "ref_id", "tf") == rows(search.phrase_hits(index, q), "query_id", "phrase_no", "ref_id", "tf")
    for match in ("any", "all"):
        a, b = (sorted((r["query_id"], r["ref_id"], round(r["score"], 9)) for r in search.bm25(p, q, match).collect()) for p in (found, index))
        assert a == b


def test_a_scan_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "b-c a")], "query_id long, question string")
    few = spark.createDataFrame([(1, "b c"), (2, "a b c")], "id long, text string")
    assert search.bm25(search.scan(search.term_lists(none, "id", "text"), q), q).count() == 0
    assert search.bm25(search.scan(search.term_lists(few, "id", "text"), q.where("false")), q.where("false")).count() == 0
    assert rows(search.bm25(search.scan(search.term_lists(few, "id", "text"), q), q), "query_id", "ref_id") == [(1, 2), (2, 2)]


def test_index_terms_are_those_of_the_index_text(spark):
    texts = ["見るABCです 12・3", "ΑΣ見ΣΑ ΟΔΟΣ", "a\u00a0b\u3000c\u2003d\u0085e", "É_x-Y.z9", "", " ", "ーｱｲ゠İI\u200bJ", "x\u30ffy\u4dffz\u9fffw"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.index_terms(F.col("t")).alias("a"), X.terms(X.index_text(F.col("t"))).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


@pytest.mark.parametrize("name", ["bm25_chunks_and_summaries", "rrf_fusion", "phrase_match", "hybrid_search", "bm25_topk"])
def test_lexical_queries_store_no_postings(spark, sf, name):
    """A stated batch of questions leaves a short row per text behind, no row per text and term."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "gridquill")
    before = set(top.glob("*"))
    catalogue.QUERIES[name](spark, sf).count()
    new = {p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - before}
    assert "scanned" in new and not new & {"row-terms", "postings", "lengths", "phrase-hits"}


def test_like_by_grams(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("AB_C1-2 x") for _ in range(rng.randint(0, 30)))
    data = [(i, text(), rng.choice([None, text()]), text()) for i in range(800)] + [(900, None, None, None), (901, "it's A\\B_1", "", "%")]
    chunks = spark.createDataFrame(data, "id long, text string, markdown string, chunk_metadata string")
    tokens = ["ABC1", "A_B_1", "B_C1", "AB1", "ABA_12", "AAA-1", "C_A2", "A__1", "ZZZZ9", "AC_1-2", "x's_1"]
    index = grams.gram_postings(chunks)
    for literal in (False, True):
        out = grams.token_hits(chunks, spark.createDataFrame([(t,) for t in tokens], "token string"), index, literal)
        got = {(r["token"], r["chunk_id"]) for r in out.collect()}
        want = set()
        for t in tokens:
            p = re.compile(re.escape(t) if literal else re.escape(t).replace("_", "."), re.I | re.S)
            want |= {(t, i) for i, *fields in data if any(f is not None and p.search(f) for f in fields)}
        assert got == want and len(got) > 50
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    short = [t for t in tokens if max(len(r) for r in t.split("_")) < 3]
    assert {"A_B_1", "A__1"} <= set(short)  # those without a gram are among the tokens tried


def test_exact_recall_with_a_stored_index(spark):
    c = spark.createDataFrame([(i, f"see ABC_{i % 3} and XYZ-{i}") for i in range(50)], "id long, text string").withColumns({"folder_id": F.col("id") % 2, "document_id": F.col("id")})
    q = spark.createDataFrame([(1, "ABC_1 or XYZ-7", None, None), (2, "ABC_2", 1, None), (3, "none", None, None)], "query_id long, question string, folder_id long, document_id long")
    index = grams.gram_postings(c).cache()
    got = search.exact_recall(c, q, 5, grams=index)
    # an identifier's first five chunks: 1 4 7 10 13 by ABC_1, 7 by XYZ-7
    assert sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got.collect()) == [(1, 1, 1.0, 1), (1, 4, 1.0, 2), (1, 7, 2.0, 0), (1, 10, 1.0, 3), (1, 13, 1.0, 4), (2, 5, 1.0, 0), (2, 11, 1.0, 1), (2, 17, 1.0, 2), (2, 23, 1.0, 3), (2, 29, 1.0, 4)]
    assert rows(got) == rows(search.exact_recall(c, q, 5))


def _vectors(spark, n=3000, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, size))
    x = centre[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, size))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ref_id long, embedding array<float>")


def test_ivf_recall_outside_the_sample(spark):
    v = _vectors(spark).cache()
    size = 600
    index = ivf.build(v, 25, sample=size)
    fitted = {r["ref_id"] for r in v.orderBy(F.xxhash64("ref_id")).limit(size).select("ref_id").collect()}
    q = v.where("ref_id % 20 = 3").withColumnRenamed("ref_id", "query_id")
    q = q.where(~F.col("query_id").isin(list(fitted)))
    probes = ivf.probes_for(v, index.centroids, 10, sample=size)
    true, got = (set(rows(x, "query_id", "ref_id")) for x in (search.knn(v, q, 10), search.ivf_knn(index, q, 10, probes)))
    assert len(true & got) >= 0.9 * len(true) and probes < len(index.centroids)
    # with all lists the search is exact
    assert rows(search.ivf_knn(index, q, 10, len(index.centroids))) == rows(search.knn(v, q, 10))
    assert index.vectors().count() == 3000


def test_ivf_appends_and_plan_size(spark):
    v = _vectors(spark, 800)
    few, many = ivf.build(v, 4), ivf.build(v, 60)
    q = v.where("ref_id < 3").withColumnRenamed("ref_id", "query_id")
    size = lambda x: len(search.ivf_knn(x, q, 5, 2)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(many) - size(few)) < 500
    many.append(spark.createDataFrame([(10_000, v.first()["embedding"])], "ref_id long, embedding array<float>"))
    got = search.ivf_knn(many, v.limit(1).select(F.lit(1).cast("long").alias("query_id"), "embedding"), 2, 1)
    assert {r["ref_id"] for r in got.collect()} == {v.first()["ref_id"], 10_000}


def test_zero_and_null_vectors_are_nobodys_neighbours(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    c = spark.createDataFrame([(i, 1, i) for i in range(1, 5)], "id long, folder_id long, document_id long")
    q = spark.createDataFrame([(1, [1.0, 0.1], 1, None), (2, [0.0, 0.0], 1, None), (3, None, 1, None), (4, [0.0, 0.0], None, None)], "query_id long, embedding array<float>, folder_id long, document_id long")
    ref = v.withColumnRenamed("chunk_id", "ref_id")
    want = [(1, 2, 0), (1, 4, 1)]
    assert rows(search.knn(ref, q, 5), "query_id", "ref_id", "rank") == want
    for mode in ("pre", "post"):
        assert rows(search.chunk_recall(v, q, c, 5, mode), "query_id", "chunk_id", "rank") == want
    index = ivf.build(ref, 2)
    assert rows(search.ivf_knn(index, q, 5, 2), "query_id", "ref_id", "rank") == want
    assert search.ivf_knn(ivf.build(ref.where("ref_id = 1"), 2), q, 5, 2).count() == 0


def test_a_failing_path_names_itself(spark):
    chunks = spark.createDataFrame([(1, "ABC_12 budget"), (2, "other budget")], "id long, text string").withColumns({c: F.col("id") for c in ("sheet_id", "document_id", "folder_id")})
    sheets = chunks.select("sheet_id", F.lit("s").alias("name"))
    documents = chunks.select("id", F.lit("f").alias("filename"))
    q = spark.createDataFrame([(1, "ABC_12 budget", [1.0, 0.0])], "query_id long, question string, embedding array<float>")
    post = search.postings(chunks, "id", "text")
    vec = chunks.select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    broken = vec.withColumn("embedding", F.array(F.raise_error(F.lit("no vectors")).cast("float")))
    none = spark.createDataFrame([], "id long, chunk_id long, embedding array<float>")
    out = search.hybrid_search(q, chunks, sheets, documents, post, broken, none, isolate=True).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out][0] == 1 and set(out[0]["sources"].split(",")) == {"fts", "exact"}
    assert list(out[0]["failed"]) == ["vec_chunk"]
    well = search.hybrid_search(q, chunks, sheets, documents, post, vec, none, isolate=True)
    assert well.first()["failed"] == {} and rows(well.drop("failed")) == rows(search.hybrid_search(q, chunks, sheets, documents, post, vec, none))
    assert Counter(well.columns)["failed"] == 1
