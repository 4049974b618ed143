"""Shared pieces of the training-data operators: scratch tables, splits, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python form of the word pattern; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session that has none (tests, a laptop) gets a temporary one: on a cluster every
    machine would write to its own disk, so there it is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        path = tempfile.mkdtemp(prefix="gridquill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gridquill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there,
    columns are pruned on reading, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridquill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_gridquill_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of the text, null as empty: what the Arrow functions take."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def word_count(text: str | Column) -> Column:
    """Number of words, in the JVM: gaps between words are squeezed, then counted."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def lower_words(data: bytes) -> list[bytes]:
    """Words with A-Z in lower case (bytes.lower changes nothing else)."""
    return data.lower().split()


def slices(column: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, values) of consecutive stretches of about ``limit`` bytes, so that a large
    Arrow batch is never held a second time as Python objects."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, end, column.slice(at, end - at).to_pylist()
        at = end


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps for a small logistic regression; returns weights and bias for raw ``x``."""
    if x.ndim == 1:
        x = x[:, None]
    if not len(y):
        return np.zeros(x.shape[1]), 0.0
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1.0, sd)
    z = np.c_[(x - mean) / sd, np.ones(len(y))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        r = p * (1 - p) + 1e-9
        step = np.linalg.solve((z * r[:, None]).T @ z + l2 * np.eye(len(w)), z.T @ (p - y) + l2 * w)
        w -= np.clip(step, -1, 1)
    a = w[:-1] / sd
    return a, float(w[-1] - (a * mean).sum())


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, max_docs: int, name: str) -> DataFrame:
    """(doc_id, text, label) of at most ``max_docs`` labelled documents for which ``keep`` holds.

    The choice is by hash of the id, so reruns agree; the ids, at most ``max_docs`` of them,
    are the only thing broadcast, so texts are not shuffled. Of equal texts one stays: else a
    document copied a thousand times would be a thousand labels.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(keep)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    got = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .withColumn("text_hash", F.md5("text"))
    )
    got = materialize(got, f"{name}-labelled")
    first = got.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    return got.join(F.broadcast(first), ["text_hash", "doc_id"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
