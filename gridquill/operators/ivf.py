"""Stored vector index: vectors in lists by nearest centroid.

Centroids are fitted on a bounded sample; every vector is assigned to its list inside Arrow batches, against a
broadcast array of the centroids (about the square root of the number of vectors, times their size), and
written to a folder per list. New vectors are appended the same way. A search takes the stated query set in blocks over the
lists that its queries look at: the folders of other lists are not read, and vectors never move; only the k
nearest of a query leave a batch. Null and zero vectors have no direction: they are kept out of the lists and find nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_dir


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)


def directed(batch: pa.RecordBatch, column: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows that have a direction, and their unit vectors."""
    batch = batch.filter(pa.array(batch.column(column).is_valid().to_numpy(zero_copy_only=False)))
    if not batch.num_rows:
        return batch, np.zeros((0, 1))
    x = unit(np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1))
    keep = np.isfinite(x).all(1)
    return batch.filter(pa.array(keep)), x[keep]


def query_blocks(queries: DataFrame, size: int):
    """(ids, unit embeddings) of the stated query set, ``size`` at a time."""
    part: list = []

    def block():
        x = unit(np.array([r[1] for r in part], np.float64))
        keep = np.isfinite(x).all(1)
        return [r[0] for r, k in zip(part, keep, strict=True) if k], x[keep]

    for r in queries.select("query_id", "embedding").where("embedding is not null").orderBy("query_id").toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield block()
            part = []
    if part:
        yield block()


def best_rows(ref: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Per column of ``score`` the first k rows, by score and then id."""
    return np.lexsort((np.broadcast_to(ref[:, None], score.shape), -score), axis=0)[: min(k, len(ref))]


def _sample(vectors: DataFrame, size: int) -> np.ndarray:
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("ref_id")).limit(size).select("embedding").collect()
    x = unit(np.array([r[0] for r in rows], dtype=float).reshape(len(rows), -1))
    return x[np.isfinite(x).all(1)] if len(rows) else x


def fit(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Centroids from at most ``sample`` vectors, chosen by a hash of their id."""
    x = _sample(vectors, sample)
    if not len(x):
        return np.zeros((0, 1))
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(vectors: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.97, sample: int = 20_000, queries: int = 300) -> int:
    """The least number of lists in which that share of the true k nearest neighbours lies, for
    ``queries`` of at most ``sample`` vectors, held against all of that sample."""
    x = _sample(vectors, sample)
    if not len(x):
        return 1
    q = x[:queries]
    near = np.argsort(-(q @ x.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # of every list, for a query
    home = (x @ centroids.T).argmax(1)
    at = np.take_along_axis(place, home[near], axis=1)
    return next(p for p in range(1, len(centroids) + 1) if (at < p).mean() >= recall)


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row; an index fitted on nothing has one list."""
    if not len(centroids):
        return np.zeros((len(x), 1), np.int64)
    score = x @ centroids.T
    return score.argmax(1)[:, None] if n == 1 else np.argsort(-score, axis=1, kind="stable")[:, :n]


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str  # ref_id, embedding in folders by list
    centroids: np.ndarray
    kind: str  # of ref_id

    def append(self, vectors: DataFrame) -> None:
        """Assigns and stores more vectors (ref_id, embedding)."""
        shared, kind = self.spark.sparkContext.broadcast(self.centroids), dict(vectors.dtypes)["embedding"]

        def run(batches):
            for b in batches:
                b, x = directed(b, 1)
                if b.num_rows:
                    near = np.concatenate([nearest_lists(x[at : at + 4096], shared.value, 1)[:, 0] for at in range(0, len(x), 4096)])
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], names=["ref_id", "embedding", "list"])

        placed = vectors.select("ref_id", "embedding").mapInArrow(run, f"ref_id {self.kind}, embedding {kind}, list int")
        # a list's rows go to few files; a large list is split by size
        placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(self.path)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"ref_id {self.kind}, embedding array<float>, list int").parquet(self.path)

    def search(self, queries: DataFrame, k: int, probes: int, block: int = 512) -> DataFrame:
        """(query_id, ref_id, score): the k nearest of each batch that lie in the ``probes`` nearest lists of a query; the
        caller takes the k best of them."""
        kind, found = dict(queries.dtypes)["query_id"], None
        for ids, q in query_blocks(queries, block):
            if not len(ids):
                continue
            near = nearest_lists(q, self.centroids, probes)
            looks = np.zeros((max(1, len(self.centroids)), len(ids)), bool)
            looks[near.T, np.arange(len(ids))] = True
            shared = self.spark.sparkContext.broadcast((ids, q, looks))
            wanted = self.spark.createDataFrame([(int(i),) for i in np.unique(near)], "list int")
            rows = self.vectors().join(F.broadcast(wanted), "list", "left_semi").select("ref_id", "embedding", "list")
            part = rows.mapInArrow(_in_lists(shared, k), f"query_id {kind}, ref_id {self.kind}, score double")
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], f"query_id {kind}, ref_id {self.kind}, score double")


def _in_lists(shared, k: int):
    def run(batches):
        ids, q, looks = shared.value
        for b in batches:
            b, x = directed(b, 1)
            if not b.num_rows:
                continue
            lists = b.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(lists, kind="stable")
            ref = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(lists[order])) + 1
            for rows in np.split(order, cuts):
                asked = np.flatnonzero(looks[lists[rows[0]]])
                if len(asked):
                    score = np.round(x[rows] @ q[asked].T, 6)
                    best = best_rows(ref[rows], score, k)
                    at, of = best.T.ravel(), np.repeat(np.arange(len(asked)), len(best))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[asked[i]] for i in of]), pa.array(ref[rows][at]), pa.array(score[at, of])], names=["query_id", "ref_id", "score"])

    return run


def build(vectors: DataFrame, lists: int, sample: int = 20_000, path: str | None = None) -> VectorIndex:
    """Index of (ref_id, embedding): fitted on a sample, every vector stored."""
    spark = vectors.sparkSession
    path = path or f"{scratch_dir(spark)}/gridquill/ivf-{uuid.uuid4().hex}"
    index = VectorIndex(spark, path, fit(vectors, lists, sample), dict(vectors.dtypes)["ref_id"])
    index.append(vectors)
    return index
