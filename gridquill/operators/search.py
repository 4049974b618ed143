"""Retrieval: recall paths, fusion, hydration, rerank, context. The indexes behind the paths are ``lexical`` (BM25),
``grams`` (LIKE) and ``ivf`` (vectors).

All operators take a table of queries (query_id, ...), so one plan serves one query or a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..storage import stored
from . import grams as G
from . import ivf
from .lexical import Index, Scan, as_index, bm25, bm25_top, build_index, corpus_stats, lengths, phrase_hits, postings, scan, term_lists, term_stats  # noqa: F401

SOURCES = ["vec_chunk", "vec_summary", "fts", "exact"]
RRF_K = 60
RECALL, FINAL = 30, 5


# lexical and exact ---------------------------------------------------------------------------


def top(scored: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Best ``n`` per query, ties by id; Spark cuts each task's share before the shuffle."""
    order = [F.desc(F.round("score", 9)), *(by or ["chunk_id"])]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).where(F.col("rank") < n)


def in_scope(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, ...) whose chunk lies in the query's folder and document."""
    q = queries.select("query_id", F.col("folder_id").alias("qf"), F.col("document_id").alias("qd")) if "folder_id" in queries.columns else None
    if q is None:
        return hits
    c = chunks.select(F.col("id").alias("chunk_id"), "folder_id", "document_id")
    out = hits.join(c, "chunk_id").join(q, "query_id")
    return out.where((F.col("qf").isNull() | (F.col("qf") == F.col("folder_id"))) & (F.col("qd").isNull() | (F.col("qd") == F.col("document_id")))).drop("qf", "qd", "folder_id", "document_id")


def fts_recall(post: DataFrame | Index | Scan, queries: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None, limit: int = RECALL, match: str = "all") -> DataFrame:
    """(query_id, chunk_id, score, rank): scope, then 2 * limit rows of the index, best per chunk,
    then the cut to ``limit``. Statistics stay global. A stored index is pruned by its blocks."""

    def cut(s: DataFrame) -> DataFrame:
        own = s.where("kind = 'chunk'").select("query_id", F.col("ref_id").alias("chunk_id"), "score", "kind", "ref_id")
        if summaries is not None:
            via = s.where("kind = 'summary'").join(summaries.select(F.col("id").alias("ref_id"), "chunk_id"), "ref_id")
            own = own.unionByName(via.select("query_id", "chunk_id", "score", "kind", "ref_id"))
        return top(in_scope(own, chunks, queries), 2 * limit, ["kind", "ref_id"])

    scored = bm25_top(post, queries, 2 * limit, cut) if isinstance(post, Index) and match == "all" else bm25(post, queries, match)
    return top(cut(scored).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), limit)


def exact_recall(chunks: DataFrame, queries: DataFrame, limit: int = RECALL, literal: bool = False, grams: DataFrame | None = None) -> DataFrame:
    """Score: number of the question's identifiers found (LIKE, case blind, '_' a wildcard unless
    literal) in text, markdown or metadata; per identifier the first ``limit`` chunks by id. ``grams``: the stored
    grams.gram_postings of the chunks; without them those that the identifiers have are made for this call."""
    tok = stored(G.question_tokens(queries), "tokens")
    if tok.isEmpty():
        return top(queries.where("false").select("query_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")), limit)
    if grams is None:
        wanted = G.token_grams(tok, literal).select(F.explode("grams").alias("gram")).distinct()
        grams = stored(G.gram_postings(chunks).join(wanted, "gram", "left_semi"), "grams")
    hits = G.token_hits(chunks, tok, grams, literal)
    return top(G.rank_hits(in_scope(hits.join(tok, "token"), chunks, queries), limit), limit)


# vectors -------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


BLOCK = 512  # queries that a pass over the vectors answers


def _nearest(shared, k: int):
    """Per batch of vectors the k nearest of every query of a block, ties by id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, q = shared.value
        for b in batches:
            b, x = ivf.directed(b, 1)
            if not b.num_rows:
                continue
            ref = b.column(0).to_numpy(zero_copy_only=False)
            score = np.round(x @ q.T, 6)
            best = ivf.best_rows(ref, score, k)
            rows, of = best.T.ravel(), np.repeat(np.arange(len(ids)), len(best))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in of]), pa.array(ref[rows]), pa.array(score[rows, of])], names=["query_id", "ref_id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = RECALL) -> DataFrame:
    """(query_id, ref_id, score, rank): k nearest by cosine of (ref_id, embedding); exact. The stated
    query set goes over all vectors in blocks, a matrix product a batch; of a batch only the k nearest of a
    query leave the task. Null and zero vectors are nobody's neighbours and have none."""
    spark, kind = vectors.sparkSession, dict(queries.dtypes)["query_id"]
    ref = dict(vectors.dtypes)["ref_id"]
    found = None
    for block in ivf.query_blocks(queries, BLOCK):
        if not len(block[0]):
            continue
        part = vectors.select("ref_id", "embedding").mapInArrow(_nearest(spark.sparkContext.broadcast(block), k), f"query_id {kind}, ref_id {ref}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {kind}, ref_id {ref}, score double")
    return top(found, k, ["ref_id"])


def ivf_knn(index: ivf.VectorIndex, queries: DataFrame, k: int = RECALL, probes: int = 4) -> DataFrame:
    """As knn, over the ``probes`` nearest lists of each query only; all vectors are indexed."""
    return top(index.search(queries, k, probes, BLOCK), k, ["ref_id"])


def chunk_recall(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = RECALL, scope_mode: str = "post") -> DataFrame:
    """Nearest chunks. post: the k nearest of all, then the scope (fewer may remain); pre: the k
    nearest of the scope."""
    v = vectors.select(F.col("chunk_id").alias("ref_id"), "embedding")
    if scope_mode == "pre" and "folder_id" in queries.columns:
        # queries that name a folder meet the vectors of that folder, those that name a document the
        # vectors of that; only queries without a scope go over all
        c = chunks.select(F.col("id").alias("ref_id"), "folder_id", "document_id")
        q = queries.select("query_id", F.col("embedding").alias("q"), F.col("folder_id").alias("qf"), F.col("document_id").alias("qd"))
        own = v.join(c, "ref_id")
        by_document = own.join(q.where("qd is not null"), F.col("document_id") == F.col("qd")).where("qf is null or qf = folder_id")
        by_folder = own.join(q.where("qd is null and qf is not null"), F.col("folder_id") == F.col("qf"))
        scored = by_document.unionByName(by_folder).select("query_id", F.col("ref_id").alias("chunk_id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).where("score is not null")
        free = knn(own.select("ref_id", "embedding"), queries.where("folder_id is null and document_id is null"), k)
        return top(scored.unionByName(free.select("query_id", F.col("ref_id").alias("chunk_id"), "score")), k)
    hits = knn(v, queries, k).select("query_id", F.col("ref_id").alias("chunk_id"), "score")
    known = hits.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return top(in_scope(known, chunks, queries), k)


def summary_recall(summaries: DataFrame, queries: DataFrame, chunks: DataFrame | None = None, k: int = RECALL) -> DataFrame:
    """k nearest summaries first, then the best one per chunk (so fewer than k chunks remain)."""
    near = knn(summaries.select(F.col("id").alias("ref_id"), "embedding"), queries, k)
    via = near.join(summaries.select(F.col("id").alias("ref_id"), "chunk_id"), "ref_id")
    if chunks is not None:
        via = in_scope(via.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), chunks, queries)
    return top(via.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


# fusion and after ----------------------------------------------------------------------------


def fuse(lists: dict[str, DataFrame], limit: int = RECALL, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion with zero-based ranks: 1 / (k + rank), added in source order; ties
    go to the chunk met first. Columns query_id, chunk_id, score, sources, rank."""
    parts = [df.select("query_id", "chunk_id", "rank", F.lit(SOURCES.index(s)).alias("src")) for s, df in lists.items()]
    ranked = parts[0]
    for p in parts[1:]:
        ranked = ranked.unionByName(p)
    term = [F.coalesce(F.max(F.when(F.col("src") == i, F.lit(1.0) / (k + F.col("rank")))), F.lit(0.0)) for i in range(len(SOURCES))]
    total = term[0] + term[1] + term[2] + term[3]
    names = F.array(*(F.lit(s) for s in SOURCES))
    out = ranked.groupBy("query_id", "chunk_id").agg(total.alias("score"), F.min(F.struct("src", "rank")).alias("first"), F.array_join(F.transform(F.sort_array(F.collect_set("src")), lambda i: F.get(names, i)), ",").alias("sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "chunk_id")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit).drop("first")


def hydrate(hits: DataFrame, chunks: DataFrame, sheets: DataFrame, documents: DataFrame) -> DataFrame:
    """Details of the hits; ids without a chunk, sheet or document drop out. The hits, ``recall`` rows of each query of a
    stated batch, are broadcast: texts of chunks are not shuffled."""
    c = chunks.select(F.col("id").alias("chunk_id"), *(x for x in ("sheet_id", "document_id", "folder_id", "text", "markdown", "hierarchy_path", "chunk_metadata") if x in chunks.columns))
    s = sheets.select("sheet_id", F.col("name").alias("sheet_name"), *(x for x in ("sheet_type",) if x in sheets.columns))
    d = documents.select(F.col("id").alias("document_id"), "filename")
    return F.broadcast(hits).join(c, "chunk_id").join(s, "sheet_id").join(d, "document_id")


def term_overlap(question: Column, text: Column) -> Column:
    """Default scorer where no cross encoder is installed: share of the question's terms in the text."""
    q = F.array_distinct(X.terms(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.terms(text))) / F.size(q)).otherwise(0.0)


def cross_encoder(model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` from a model factory, which runs once per task; the model scores a batch of
    (question, text) pairs at a time."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        apply = model()
        for questions, texts in batches:
            yield pd.Series(apply(list(zip(questions.fillna(""), texts.fillna(""), strict=True))), dtype=float)

    return lambda question, text: run(question, text)


def rerank(hits: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = term_overlap, limit: int = FINAL) -> DataFrame:
    """Scores candidates against the question; ties keep the fused order."""
    x = hits.withColumnsRenamed({"score": "rrf", "rank": "rrf_rank"}).join(queries.select("query_id", "question"), "query_id")
    x = x.withColumn("score", scorer(F.col("question"), F.coalesce(F.col("text"), F.lit(""))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rrf_rank")
    return x.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def recall_paths(paths: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each path run by itself and stored; one that fails gives no list, and its error is returned by its name."""
    lists, errors = {}, {}
    for name, make in paths.items():
        try:
            lists[name] = stored(make().select("query_id", "chunk_id", "score", "rank"), f"recall-{name}")
        except Exception as e:  # noqa: BLE001 - a path's failure is its own
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
    return lists, errors


def hybrid_search(queries: DataFrame, chunks: DataFrame, sheets: DataFrame, documents: DataFrame, post: DataFrame | Index | Scan, chunk_vec: DataFrame, summaries: DataFrame, limit: int = FINAL, recall: int = RECALL, scorer: Callable[[Column, Column], Column] = term_overlap, grams: DataFrame | None = None, isolate: bool = False) -> DataFrame:
    """queries: query_id, question, embedding and, if scoped, folder_id and document_id. isolate: a recall path that
    fails leaves the lists of the others; a row's ``failed`` names the paths that failed and their errors."""
    if limit <= 0 or recall <= 0:
        raise ValueError("limit and recall must be positive")
    paths = {
        "vec_chunk": lambda: chunk_recall(chunk_vec, queries, chunks, recall),
        "vec_summary": lambda: summary_recall(summaries, queries, chunks, recall),
        "fts": lambda: fts_recall(post, queries, chunks, summaries, recall),
        "exact": lambda: exact_recall(chunks, queries, recall, grams=grams),
    }
    if not isolate:
        return rerank(hydrate(fuse({k: make() for k, make in paths.items()}, recall), chunks, sheets, documents), queries, scorer, limit)
    lists, errors = recall_paths(paths)
    if not lists:
        raise RuntimeError("; ".join(f"{k}: {v}" for k, v in errors.items()))
    out = rerank(hydrate(fuse(lists, recall), chunks, sheets, documents), queries, scorer, limit)
    failed = F.create_map(*(F.lit(x) for pair in errors.items() for x in pair)) if errors else F.create_map().cast("map<string,string>")
    return out.withColumn("failed", failed)


def context(hits: DataFrame, queries: DataFrame, empty: str = "没有检索到相关内容。") -> DataFrame:
    """query_id, context, citations: hits numbered from 1, one block each; a fixed text without hits."""
    h = hits.withColumn("index", F.col("rank") + 1)
    kind = F.col("sheet_type") if "sheet_type" in hits.columns else F.lit("unknown")
    path = F.coalesce(F.nullif(F.col("hierarchy_path"), F.lit("")), F.lit("-")) if "hierarchy_path" in hits.columns else F.lit("-")
    body = F.coalesce(F.col("markdown") if "markdown" in hits.columns else F.col("text"), F.lit(""))
    block = F.concat(F.lit("[#"), F.col("index").cast("string"), F.lit("] 文件: "), "filename", F.lit(" | 工作表: "), "sheet_name", F.lit(" ("), kind, F.lit(") | 层级: "), path, F.lit("\n"), body)
    out = h.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"),
        F.to_json(F.sort_array(F.collect_list(F.struct("index", "chunk_id", "filename", "sheet_name", "score", "sources")))).alias("citations"),
    )
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit(empty)).alias("context"), F.coalesce("citations", F.lit("[]")).alias("citations"))


def prompt(template: str, question: Column, context_: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{question}"), question), F.lit("{context}"), context_)
