"""Lexical index and BM25.

The index has a row per row of text and term (``Index.post``: term frequency, length, positions as one array), the number of
rows of each term, and *blocks*: rows of similar length, some 256 at a time, for each of which and each term
the best BM25 weight is kept. A search for the k best rows first meets blocks instead of rows: a block
that lacks a term is out, and one whose bound is below the k-th best score found in the most promising
blocks is out too. In the blocks left the rows of the query's rarest phrase are the candidates, and the other
phrases are looked up for these rows alone, so that no frequent term is expanded for a query. Positions are
read for rows that hold all terms of a phrase of several terms.

Blocks are met only by queries whose rarest phrase is in more than ``WHOLE`` rows: below that all candidates are scored at once.

A batch of queries that is known beforehand needs no index: ``scan`` reads the texts once and keeps, per row, how often it
holds the phrases of the batch (``Scan``), from which the same answers come row by row, without a shuffle of postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..storage import stored

K1, B = 1.2, 0.75
BLOCK_ROWS, FIRST_BLOCKS, WHOLE = 256, 16, 20_000
ROW = ["kind", "ref_id"]


def postings(rows: DataFrame, id_col: str, text_col: str, kind: str = "chunk", tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """kind, ref_id, term, pos. ``tokenizer`` maps a text column to an array of terms, such as a morphological
    analyser in a pandas UDF; without one the built-in fallback cuts words and characters."""
    return term_lists(rows, id_col, text_col, kind, tokenizer).select(*ROW, F.posexplode("terms").alias("pos", "term"))


def term_lists(rows: DataFrame, id_col: str, text_col: str, kind: str = "chunk", tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """kind, ref_id, terms: the terms of a row in order, for ``scan``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tok = tokenizer(text) if tokenizer else X.index_terms(text)
    return rows.select(F.lit(kind).alias("kind"), F.col(id_col).alias("ref_id"), tok.alias("terms"))


def lengths(post: DataFrame) -> DataFrame:
    """kind, ref_id, dl: terms of every row of the index."""
    return post.groupBy(*ROW).agg(F.count("*").alias("dl"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """n_rows, avg_len over all rows of the index, chunks and summaries together."""
    return lengths(post).agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_len"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.countDistinct(*ROW).alias("df"), F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """post: kind, ref_id, term, tf, dl, pos, block. terms: term, df. blocks: term, block, n, best. n_rows, avg_len: of
    all rows."""

    post: DataFrame
    terms: DataFrame
    blocks: DataFrame
    n_rows: int
    avg_len: float


def _weight(tf: Column, dl: Column, avg_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avg_len or 1.0)))


def _idf(n_rows: int, df: Column) -> Column:
    idf = F.log((F.lit(n_rows) - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(1e-6)


def build_index(post: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """Stores the tables of the index of ``postings`` in the shared folder. Terms are sorted within the files, so
    that a search skips the row groups without its terms."""
    rows = stored(post.groupBy(*ROW, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("pos")), "row-terms")
    own = stored(rows.groupBy(*ROW).agg(F.sum("tf").alias("dl")), "lengths")
    n_rows, avg_len = own.agg(F.count("*"), F.avg("dl")).first()
    # a block: rows whose lengths differ by less than a fifth, dealt by a hash of the row
    length = F.floor(4 * F.log2("dl"))
    parts = own.groupBy(length.alias("length")).agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    own = own.withColumn("length", length).join(F.broadcast(parts), "length")  # some 4 rows for each doubling of the longest text
    own = own.select(*ROW, "dl", (F.col("length") * F.lit(1 << 40) + F.pmod(F.xxhash64(*ROW), F.col("parts"))).alias("block"))
    placed = rows.join(own, ROW)
    entries = stored(placed.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), "postings")
    terms = stored(entries.groupBy("term").agg(F.count("*").alias("df")), "terms")
    best = F.max(_weight(F.col("tf"), F.col("dl"), avg_len or 0.0)).alias("best")
    blocks = stored(entries.groupBy("term", "block").agg(F.count("*").alias("n"), best), "blocks")
    return Index(entries, terms, blocks, n_rows, avg_len or 0.0)


def _flat(post: DataFrame) -> Index:
    """An index of raw postings for one use, in one block."""
    rows = post.groupBy(*ROW, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("pos"))
    n_rows, avg_len = corpus_stats(post).first()
    entries = rows.join(lengths(post), ROW).withColumn("block", F.lit(0).cast("long"))
    terms = entries.groupBy("term").agg(F.count("*").alias("df"))
    return Index(entries, terms, terms.select("term", F.lit(0).cast("long").alias("block"), F.col("df").alias("n"), F.lit(K1 + 1).alias("best")), n_rows, avg_len or 0.0)


def as_index(post: DataFrame | Index) -> Index:
    return post if isinstance(post, Index) else _flat(post)


def _phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase_no, phrase (array of terms), len, term (of a phrase of one)."""
    out = queries.select("query_id", F.posexplode(X.query_phrases(F.col("question"))).alias("phrase_no", "phrase"))
    return out.select("*", F.size("phrase").alias("len"), F.when(F.size("phrase") == 1, F.get("phrase", F.lit(0))).alias("term"))


def _long_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(query_id, phrase_no, kind, ref_id, dl, block, tf) of phrases of several terms: the rows of the rarest term,
    those of them that hold the other terms, and only there the positions."""
    each = phrases.where("len > 1").select("query_id", "phrase_no", "len", F.posexplode("phrase").alias("i", "term"))
    wanted = each.select("query_id", "phrase_no", "term").distinct().join(index.terms, "term")
    rarest = wanted.groupBy("query_id", "phrase_no").agg(F.min(F.struct("df", "term")).alias("r")).select("query_id", "phrase_no", F.col("r.term").alias("term"))
    rows = index.post.select(*ROW, "term").join(rarest, "term").select("query_id", "phrase_no", *ROW)
    placed = rows.join(each, ["query_id", "phrase_no"]).join(index.post.select(*ROW, "term", "dl", "block", "pos"), [*ROW, "term"])
    starts = placed.select("query_id", "phrase_no", "len", *ROW, "dl", "block", F.explode(F.transform("pos", lambda p: p - F.col("i"))).alias("start"))
    met = starts.groupBy("query_id", "phrase_no", "len", *ROW, "dl", "block", "start").agg(F.count("*").alias("n")).where("n = len")
    return met.groupBy("query_id", "phrase_no", *ROW, "dl", "block").agg(F.count("*").alias("tf"))


def phrase_hits(post: DataFrame | Index | Scan, queries: DataFrame) -> DataFrame:
    """(query_id, phrase_no, kind, ref_id, tf) for each phrase that a row holds at adjacent positions."""
    cols = ["query_id", "phrase_no", *ROW, "tf"]
    if isinstance(post, Scan):
        return _scan_hits(post, queries).select(*cols)
    index = as_index(post)
    phrases = _phrases(queries)
    short = index.post.join(phrases.where("len = 1").select("query_id", "phrase_no", "term"), "term")
    return short.select(*cols).unionByName(_long_hits(index, phrases).select(*cols))


def bm25(post: DataFrame | Index | Scan, queries: DataFrame, match: str = "all", within: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, ref_id, score): rows that hold all phrases (or any, match='any'). ``post``: postings, an
    index, or a scan for these queries. ``within`` (query_id, block) leaves out the rows of other blocks of an index."""
    if isinstance(post, Scan):
        return _scan_bm25(post, queries, match)
    index = as_index(post)
    phrases = stored(_phrases(queries), "phrases")
    known = phrases.where("len = 1").join(index.terms, "term").select("query_id", "phrase_no", "term", "df")
    long_hits = None
    if not phrases.where("len > 1").isEmpty():
        long_hits = stored(_long_hits(index, phrases), "phrase-hits")
        long_df = long_hits.groupBy("query_id", "phrase_no").agg(F.count("*").alias("df"))
        known = known.unionByName(long_df.withColumn("term", F.lit(None).cast("string")))
    known = stored(known.withColumn("idf", _idf(index.n_rows, F.col("df"))), "phrase-weights")
    part = (F.col("idf") * _weight(F.col("tf"), F.col("dl"), index.avg_len)).alias("part")
    entries = index.post.select("term", *ROW, "tf", "dl", "block")
    if match != "all":
        hits = entries.join(known.where("term is not null"), "term").select("query_id", *ROW, part)
        if long_hits is not None:
            hits = hits.unionByName(long_hits.join(known.where("term is null"), ["query_id", "phrase_no"]).select("query_id", *ROW, part))
        return hits.groupBy("query_id", *ROW).agg(F.sum("part").alias("score"))
    # queries all of whose phrases occur somewhere, and of each the rarest phrase
    need = phrases.groupBy("query_id").agg(F.count("*").alias("need"))
    alive = known.groupBy("query_id").agg(F.count("*").alias("found"), F.min(F.struct("df", "phrase_no")).alias("lead")).join(need, "query_id").where("found = need")
    known = known.join(alive.select("query_id", "need", F.col("lead.phrase_no").alias("lead")), "query_id")
    led, rest = known.where("phrase_no = lead"), known.where("phrase_no <> lead")
    cols = ["query_id", "need", *ROW, "block", part]
    first = entries.join(led.where("term is not null"), "term").select(*cols)
    if long_hits is not None:
        first = first.unionByName(long_hits.join(led.where("term is null"), ["query_id", "phrase_no"]).select(*cols))
    if within is not None:
        first = first.join(within, ["query_id", "block"], "left_semi")
    asked = first.select("query_id", *ROW).join(rest.select("query_id", "phrase_no", "term", "idf"), "query_id")
    # only entries of terms that are asked for are shuffled
    pool = entries.join(rest.where("term is not null").select("term").distinct(), "term", "left_semi")
    more = asked.where("term is not null").join(pool, [*ROW, "term"]).select("query_id", *ROW, part)
    if long_hits is not None:
        more = more.unionByName(asked.where("term is null").join(long_hits.drop("block"), ["query_id", "phrase_no", *ROW]).select("query_id", *ROW, part))
    parts = first.select("query_id", *ROW, "part", "need").unionByName(more.withColumn("need", F.lit(None).cast("long")))
    scored = parts.groupBy("query_id", *ROW).agg(F.sum("part").alias("score"), F.count("*").alias("n"), F.max("need").alias("need"))
    return scored.where("n = need").select("query_id", *ROW, "score")


def bm25_top(index: Index, queries: DataFrame, k: int, cut: Callable[[DataFrame], DataFrame], first_blocks: int = FIRST_BLOCKS, whole: int = WHOLE) -> DataFrame:
    """The rows of ``bm25`` (match='all') from which ``cut`` has everything it needs: ``cut`` keeps a query's best
    ``k`` rows in its scope (query_id, score, ...). Queries whose phrases have one term each, all in more than ``whole`` rows,
    are pruned by blocks; a phrase of several terms has no bound before it is found, so queries with one are scored
    whole, like those with a rare term."""
    phrases = _phrases(queries).join(index.terms, "term", "left")
    sizes = phrases.groupBy("query_id").agg(F.max("len").alias("longest"), F.count("*").alias("need"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
    plain = stored(queries.join(sizes.where((F.col("longest") == 1) & (F.col("least") > whole)).select("query_id", "need"), "query_id"), "frequent-queries")
    if plain.isEmpty():
        return bm25(index, queries)
    terms = _phrases(plain).join(index.terms, "term").select("query_id", "term", _idf(index.n_rows, F.col("df")).alias("idf"))
    met = terms.join(index.blocks, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count("*").alias("n"))
    met = met.join(plain.select("query_id", "need"), "query_id").where("n = need").select("query_id", "block", "bound")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    lead = stored(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first_blocks).select("query_id", "block"), "first-blocks")
    found = stored(bm25(index, plain, within=lead), "first-rows")
    # the k-th best score of a query that has so many rows already; rounding may lift a score by half a billionth
    bar = cut(found).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", (F.col("bar") - 1e-8).alias("bar"))
    left = met.join(lead, ["query_id", "block"], "left_anti").join(bar, "query_id", "left").where("bar is null or bound >= bar").select("query_id", "block")
    left = stored(left, "more-blocks")
    if not left.isEmpty():
        found = found.unionByName(stored(bm25(index, plain.join(left.select("query_id").distinct(), "query_id", "left_semi"), within=left), "more-rows"))
    others = queries.join(plain.select("query_id"), "query_id", "left_anti")
    return found if others.isEmpty() else found.unionByName(bm25(index, others))


# one pass for a batch of queries ---------------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """rows: kind, ref_id, dl, found (phrases of the batch that the row holds, ascending), tf. phrases: numbers of the phrases.
    df: rows by phrase. n_rows, avg_len: of all rows that have a term."""

    rows: DataFrame
    phrases: dict[tuple[str, ...], int]
    df: dict[int, int]
    n_rows: int
    avg_len: float


class _Trie:
    """Phrases by their terms; a step from all places at once is a search in sorted keys."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        code = {t: i for i, t in enumerate(sorted({t for p in phrases for t in p}))}
        self.terms, self.width = pa.array(list(code), pa.string()), len(code)
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for no, p in enumerate(phrases):
            node = 0
            for t in p:
                node = steps.setdefault((node, code[t]), len(steps) + 1)
            ends[node] = no
        keys = np.array([n * self.width + c for n, c in steps], np.int64)
        by = np.argsort(keys)
        self.keys, self.nodes = keys[by], np.array([*steps.values()], np.int64)[by]
        self.ends = np.full(len(steps) + 1, -1, np.int64)
        self.ends[[*ends]] = [*ends.values()]

    def held(self, terms: pa.Array, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, phrases) of every occurrence; ``row`` has the row of each term."""
        code = pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(code >= 0)
        start, node = at, np.zeros(len(at), np.int64)
        while len(at):
            key = node * self.width + code[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[place] == key
            start, at, node = start[met], at[met] + 1, self.nodes[place[met]]
            whole = self.ends[node] >= 0
            yield row[start[whole]], self.ends[node[whole]]
            on = at < len(code)
            start, at, node = start[on], at[on], node[on]
            on = (row[at] == row[start]) & (code[at] >= 0)
            start, at, node = start[on], at[on], node[on]


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list per row from values sorted by row."""
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), pa.array(values))


SCAN_TERMS = 2_000_000  # terms worked on at once


def _scanned(shared):
    def run(batches):
        phrases = shared.value
        trie = _Trie(phrases)
        for b in batches:
            length = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(length), 0
            while at < len(length):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + SCAN_TERMS, side="right")))
                part, n = b.slice(at, end - at), end - at
                row = np.repeat(np.arange(n), length[at:end])
                hits = [*trie.held(part.column(2).flatten(), row)]
                key = np.concatenate([np.zeros(0, np.int64), *(r * len(phrases) + p for r, p in hits)])
                key, tf = np.unique(key, return_counts=True)
                own, found = np.divmod(key, max(len(phrases), 1))
                out = [part.column(0), part.column(1), pa.array(length[at:end]), _lists(own, found.astype(np.int32), n), _lists(own, tf.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays(out, names=[*ROW, "dl", "found", "tf"]).filter(pa.array(length[at:end] > 0))
                at = end

    return run


def scan(rows: DataFrame, queries: DataFrame) -> Scan:
    """``rows``: kind, ref_id, terms, one or more ``term_lists``. One pass over them for all phrases of ``queries``, which are
    broadcast: a stated batch, as for ``search.knn``. What is stored has a short row per text."""
    phrases = sorted({tuple(r[0]) for r in _phrases(queries).select("phrase").distinct().collect()})
    shared = rows.sparkSession.sparkContext.broadcast(phrases)
    kind = dict(rows.dtypes)["ref_id"]
    found = stored(rows.select(*ROW, "terms").mapInArrow(_scanned(shared), f"kind string, ref_id {kind}, dl long, found array<int>, tf array<long>"), "scanned")
    n_rows, avg_len = found.agg(F.count("*"), F.avg("dl")).first()
    df = {r[0]: r[1] for r in found.select(F.explode("found").alias("no")).groupBy("no").count().collect()}
    return Scan(found, {p: i for i, p in enumerate(phrases)}, df, n_rows, avg_len or 0.0)


def _asked(s: Scan, queries: DataFrame) -> DataFrame:
    """query_id, phrase_no, no: the phrases of the queries by their numbers."""
    numbers = queries.sparkSession.createDataFrame([(list(p), i) for p, i in s.phrases.items()], "phrase array<string>, no int")
    return _phrases(queries).select("query_id", "phrase_no", "phrase").join(F.broadcast(numbers), "phrase")


def _scan_hits(s: Scan, queries: DataFrame) -> DataFrame:
    """(query_id, phrase_no, no, kind, ref_id, dl, tf) of every phrase."""
    each = s.rows.select(*ROW, "dl", F.explode(F.arrays_zip("found", "tf")).alias("x")).select(*ROW, "dl", F.col("x.found").alias("no"), F.col("x.tf").alias("tf"))
    return each.join(F.broadcast(_asked(s, queries)), "no")


def _scores(shared):
    """Per row the queries all of whose phrases it holds, with their scores: first those whose rarest phrase it
    holds, then of these, phrase by phrase, those that hold the next one too."""

    def run(batches):
        ids, wanted, weight, lead, starts, avg_len, n_phrases = shared.value
        for b in batches:
            found = b.column(3)
            n = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            own, no = np.repeat(np.arange(len(n)), n), found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf, dl = b.column(4).flatten().to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[own] / (avg_len or 1.0)))
            key = own * n_phrases + no
            many = starts[no + 1] - starts[no]
            row = np.repeat(own, many)
            query = lead[np.repeat(starts[no] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            score = np.zeros(len(row))
            for i in range(wanted.shape[1]):
                want = row * n_phrases + wanted[query, i]
                place = np.minimum(np.searchsorted(key, want), len(key) - 1)
                none = wanted[query, i] < 0
                keep = none | (key[place] == want)
                score = score + np.where(none, 0.0, weight[query, i] * part[place])
                row, query, score = row[keep], query[keep], score[keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(score)], names=["query_id", *ROW, "score"])

    return run


def _scan_bm25(s: Scan, queries: DataFrame, match: str) -> DataFrame:
    spark = s.rows.sparkSession
    idf = spark.createDataFrame([*s.df.items()], "no int, df long").select("no", _idf(s.n_rows, F.col("df")).alias("idf"))
    if match != "all":
        part = (F.col("idf") * _weight(F.col("tf"), F.col("dl"), s.avg_len)).alias("part")
        return _scan_hits(s, queries).join(F.broadcast(idf), "no").select("query_id", *ROW, part).groupBy("query_id", *ROW).agg(F.sum("part").alias("score"))
    weights = {r[0]: r[1] for r in idf.collect()}
    asked: dict[object, list[int]] = {}
    for r in _asked(s, queries).select("query_id", "no").orderBy("query_id", "phrase_no").collect():
        asked.setdefault(r[0], []).append(r[1])
    # queries all of whose phrases occur somewhere, their phrases from the rarest on
    alive = {q: sorted(p, key=lambda i: (s.df[i], i)) for q, p in asked.items() if all(i in s.df for i in p)}
    kind, ref = dict(queries.dtypes)["query_id"], dict(s.rows.dtypes)["ref_id"]
    schema = f"query_id {kind}, kind string, ref_id {ref}, score double"
    if not alive:
        return spark.createDataFrame([], schema)
    most = max(map(len, alive.values()))
    wanted = np.array([p + [-1] * (most - len(p)) for p in alive.values()], np.int64)
    weight = np.array([[weights[i] for i in p] + [0.0] * (most - len(p)) for p in alive.values()])
    lead = np.argsort(wanted[:, 0], kind="stable")
    starts = np.searchsorted(wanted[lead, 0], np.arange(len(s.phrases) + 1))
    ids = spark.createDataFrame([(q,) for q in alive], f"query_id {kind}").toArrow().column(0).combine_chunks()
    shared = spark.sparkContext.broadcast((ids, wanted, weight, lead, starts, s.avg_len, len(s.phrases)))
    return s.rows.where(F.size("found") > 0).mapInArrow(_scores(shared), schema)
