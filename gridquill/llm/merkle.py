"""Merkle manifest of a dataset: a trie over exact ranks.

Every row is a leaf. Its rank in its source comes from hierarchical histograms of doc_id digits
(``radix.group_ranks``), not from a global sort. The rank, written in base ``fanout``, is the leaf's path in the trie: the
nodes of a level are keyed by source and the rank's prefix, so a level is a grouped reduction of the level below, and all nodes of
a run have their longest common prefix as parent. The roots of the sources are reduced in the same way to one root.

Going down again, every run of leaves gets the runs above it (``path``), from which each leaf's proof and the
root that follows from it are computed in the row. A leaf moves three times (rank, run, proof), at some 200 bytes; texts never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, table
from .radix import group_ranks, sorted_ranks

FANOUT_BITS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<run:binary,at:int>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row as bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _node(run: Column) -> Column:
    """Digest of a run of digests, which are hashed as hexadecimal text."""
    return F.unhex(F.sha2(_hex(run), 256))


def source_key(source: Column) -> Column:
    """A key without nulls in the order of the sources: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """row, doc_id, src, leaf, presented: the leaf as stored, and as a reader presents it who has the text in
    lower case where 5 divides the crc32 of the id (else as stored)."""
    cols = [F.col(c) for c in FIELDS]
    touched = [*cols[:4], F.translate("text", _UPPER, _LOWER)]
    out = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), source_key(F.col("source")).alias("src"),
        leaf_hash(cols).alias("leaf"), F.when(crc_mod("doc_id", 5) == 0, leaf_hash(touched)).alias("presented"),
    )
    # the first half of a digest as a key orders different rows of one doc_id
    return materialize(out.withColumn("tie", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")), "merkle-leaves")


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Runs of every level above ``nodes`` (src, rank, digest, n): src, rank of the parent, n, run (the digests of
    its children in order), digest. A group takes part until one node is left of it."""
    levels, low, left = [], 0, nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        part = nodes.where(F.col("n") > F.lit(1 << low))
        runs = part.groupBy("src", F.shiftrightunsigned("rank", FANOUT_BITS).alias("rank")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        runs = runs.withColumn("run", F.unhex(F.array_join(F.transform("run", lambda x: F.hex(x["digest"])), "")))
        nodes = materialize(runs.withColumn("digest", _node(F.col("run"))), "merkle-level")
        levels.append(nodes)
        low += FANOUT_BITS
        left = -(-left >> FANOUT_BITS)
    return levels


def _step(run: str, at: Column) -> Column:
    return F.array(F.struct(F.col(run).alias("run"), at.cast("int").alias("at")))


def with_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` (src, rank, n, ...) with path, the runs that hold the node and its ancestors and its place in each,
    lowest first, then those that ``above`` (src, n, path, subroot) has for the whole group; and with subroot. The runs of
    a level are joined once with the paths of their parents, so that only a path per run of nodes is ever moved."""
    top = above.withColumn("rank", F.lit(0).cast("long"))
    for i in reversed(range(1, len(levels))):
        parents = levels[i].select("src", "rank", "run").join(top, ["src", "rank"])
        each = parents.select("*", F.explode(F.sequence(F.lit(0), (F.length("run") / 32 - 1).cast("int"))).alias("at"))
        grown = each.select("src", "n", F.concat(_step("run", F.col("at")), "path").alias("path"), "subroot", (F.col("rank") * (1 << FANOUT_BITS) + F.col("at")).alias("rank"))
        # the trees of other groups end below this level and start further down
        top = materialize(grown.unionByName(top.where(F.col("n") <= F.lit(1 << FANOUT_BITS * i))), "merkle-paths")
    alone = nodes.where("n = 1").join(above.drop("n"), "src")
    if not levels:
        return alone
    parents = levels[0].select("src", F.col("rank").alias("up"), "run").join(top.drop("n").withColumnRenamed("rank", "up"), ["src", "up"])
    many = nodes.where("n > 1").withColumn("up", F.shiftrightunsigned("rank", FANOUT_BITS)).join(parents, ["src", "up"])
    path = F.concat(_step("run", F.col("rank").bitwiseAND((1 << FANOUT_BITS) - 1)), "path")
    return many.select(*nodes.columns, path.alias("path"), "subroot").unionByName(alone.select(*nodes.columns, "path", "subroot"))


def siblings_of(path: Column) -> Column:
    """All siblings on the way up, left to right, as hexadecimal text."""
    return F.array_join(F.transform(path, lambda p: _hex(F.concat(F.substring(p["run"], F.lit(1), p["at"] * 32), F.substring(p["run"], p["at"] * 32 + 33, F.length(p["run"]))))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from ``leaf`` and the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda acc, p: _node(F.concat(F.substring(p["run"], F.lit(1), p["at"] * 32), acc, F.substring(p["run"], p["at"] * 32 + 33, F.length(p["run"])))))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``, which has
    the columns of ``documents`` with integer ids.

    Null fields are hashed as ``-`` and differ from empty ones. Null ids come first in their source and are
    never tampered with; rows of one id follow by their leaf, equal rows are leaves of their own next to each
    other. A source of one row is its own subroot, a single source's subroot is the root. Other columns, of any name, are
    not read; texts are hashed whole; an empty table gives an empty result."""
    leaf = leaves(docs.select(*FIELDS))
    ranked = materialize(group_ranks(leaf, "src", ["doc_id", "tie", "row"]).withColumn("digest", F.col("leaf")), "merkle-ranks")
    runs = reduced(ranked.select("src", "rank", "digest", "n"))
    # subroots: the one node that each source comes down to
    ends = [ranked.where("n = 1").select("src", "n", "digest")]
    for i, level in enumerate(runs):
        ends.append(level.where(f"n <= {1 << FANOUT_BITS * (i + 1)}").select("src", "n", "digest"))
    subroots = materialize(sorted_ranks(reduce(DataFrame.unionByName, ends), [F.col("src")], "merkle-sorted"), "merkle-subroots")
    sources = subroots.count()
    if not sources:
        nothing = F.lit(None).cast("string")
        return leaf.select("doc_id", *[nothing.alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    tops = subroots.select(F.lit("").alias("src"), "rank", F.lit(sources).cast("long").alias("n"), "digest", F.col("src").alias("name"), F.col("n").alias("rows"))
    top_runs = reduced(tops.select("src", "rank", "digest", "n"))
    root = (top_runs[-1] if top_runs else subroots).select(_hex(F.col("digest"))).first()[0]
    start = docs.sparkSession.range(1).select(F.lit("").alias("src"), F.lit(sources).cast("long").alias("n"), F.from_json(F.lit("[]"), _PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    above = with_paths(tops, top_runs, materialize(start, "merkle-start")).select(F.col("name").alias("src"), F.col("rows").alias("n"), "path", F.col("digest").alias("subroot"))
    found = with_paths(ranked, runs, materialize(above, "merkle-above"))
    out = found.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
        F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"),
        _hex(folded(F.coalesce("presented", "leaf"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
