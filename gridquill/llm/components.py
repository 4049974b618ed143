"""Connected components of a distributed edge list, by alternating large-star and small-star
steps. Each step is a grouped minimum and a lookup of it from every edge; nothing is collected, and the
lineage ends in a written table every round.

A *hub*, a node with so many edges that a task which got them all would stand out, is looked up
apart: hubs have at least 1 / HUBS of all edge ends each, so there are at most HUBS of them, and
their minima are broadcast to the edges where these lie. All other nodes meet their edges in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


HUBS = 2000


def _with_least(e: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Edges (u, v) with the minimum m of u; ``least``: u, m and n, the number of u's edges."""
    limit = max(20, ends // HUBS)
    hubs, others = least.where(F.col("n") >= limit), least.where(F.col("n") < limit)
    marked = e.join(F.broadcast(hubs.select("u", "m")), "u", "left")
    near = marked.where("m is null").select("u", "v").join(others.select("u", "m"), "u")
    return marked.where("m is not null").select("u", "v", "m").unionByName(near.select("u", "v", "m"))


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(_least(both), "star-least")
    return _with_least(both.where("v > u"), least, 2 * edges).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    least = materialize(_least(e), "star-least")
    moved = _with_least(e, least, edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _written(e: DataFrame) -> DataFrame:
    """Edges are a few bytes where documents are thousands: an eighth of the usual tasks write them."""
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(e.coalesce(max(1, n // 8)), "edges")


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself. The steps keep
    components whole, so that each star then is a component and the work is done."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    odd = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
    return odd.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node
    reachable. Self links and null ends are ignored; no edges give an empty table."""
    e = (
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    e = _written(e)
    while not _is_star_forest(e):
        n = e.count()
        large = _written(_large_star(e, n).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        step = _written(_small_star(large, large.count()))
        discard(e)
        discard(large)
        e = step
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
