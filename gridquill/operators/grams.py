"""Exact recall: LIKE over several fields, by way of an index of three-character grams.

A pattern's rarest grams are looked up in the index (an equi-join), and LIKE is evaluated on the rows
that hold them. ``_`` is a wildcard, so a pattern is cut there into runs, and every run of three characters or more has grams. A
pattern without such a run (``A_B_1``) has none: these patterns, part of the stated query set, are evaluated on every row in the
same pass, ``SCAN`` at a time, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

Q, RAREST, SCAN = 3, 2, 64
FIELDS = ("text", "markdown", "chunk_metadata")


def _grams(text: Column) -> Column:
    """Distinct grams of a text, none if it is shorter: a look-ahead matches at every place, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{Q}}}))"), F.lit(1)))


def gram_postings(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """ref_id, gram: the grams of a chunk's fields, in lower case, each once."""
    fields = [c for c in FIELDS if c in chunks.columns]
    each = F.array(*(_grams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in fields))
    return chunks.select(F.col(id_col).alias("ref_id"), F.explode(F.array_distinct(F.flatten(each))).alias("gram"))


def token_grams(tokens: DataFrame, literal: bool = False) -> DataFrame:
    """``tokens`` (token) with grams, those of its runs."""
    low = F.lower("token")
    runs = F.array(low) if literal else F.split(low, "_")
    return tokens.withColumn("grams", F.array_distinct(F.flatten(F.transform(runs, _grams))))


def gram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count("*").alias("df"))


def _matches(fields: list[str], pattern: str) -> Column:
    out = F.lit(False)
    for c in fields:
        out = out | F.coalesce(F.expr(f"{c} ilike {pattern}"), F.lit(False))
    return out


def token_hits(chunks: DataFrame, tokens: DataFrame, grams: DataFrame, literal: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(token, chunk_id): chunks one of whose fields holds the token (case blind, '_' a wildcard unless ``literal``).
    ``tokens``: a column token; ``grams``: gram_postings of the chunks."""
    spark = chunks.sparkSession
    fields = [c for c in FIELDS if c in chunks.columns]
    own = chunks.select(F.col("id").alias("chunk_id"), *fields)
    escaped = F.replace("token", F.lit("_"), F.lit("\\_")) if literal else F.col("token")
    tokens = tokens.select("token").distinct().withColumn("pattern", F.concat(F.lit("%"), escaped, F.lit("%")))
    tokens = token_grams(tokens, literal)
    # the rarest grams of each token; one that occurs nowhere makes the token occur nowhere
    parts = tokens.where(F.size("grams") > 0).select("token", "pattern", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    parts = parts.join(counts if counts is not None else gram_counts(grams), "gram")
    known = parts.groupBy("token", "pattern", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("by")).where(F.size("by") == F.col("n"))
    rare = known.select("token", "pattern", F.least(F.col("n"), F.lit(RAREST)).alias("n"), F.explode(F.slice("by", 1, RAREST)["gram"]).alias("gram"))
    met = rare.join(grams, "gram").groupBy("token", "pattern", "n", "ref_id").agg(F.count("*").alias("m")).where("m = n")
    hits = met.join(own, met["ref_id"] == own["chunk_id"]).where(_matches(fields, "pattern")).select("token", "chunk_id")
    short = [tuple(r) for r in tokens.where(F.size("grams") == 0).select("token", "pattern").orderBy("token").toLocalIterator()]
    for at in range(0, len(short), SCAN):
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        found = F.array_compact(F.array(*(F.when(_matches(fields, quoted(p)), F.lit(t)) for t, p in short[at : at + SCAN])))
        hits = hits.unionByName(own.select(F.explode(found).alias("token"), "chunk_id"))
    return hits


def rank_hits(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, score) from (query_id, token, chunk_id): of every token the first ``limit`` chunks by id,
    then the number of tokens of each chunk."""
    first = hits.withColumn("i", F.row_number().over(Window.partitionBy("query_id", "token").orderBy("chunk_id"))).where(F.col("i") <= limit)
    return first.groupBy("query_id", "chunk_id").agg(F.countDistinct("token").cast("double").alias("score"))


def question_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.identifiers(F.col("question"))).alias("token"))
