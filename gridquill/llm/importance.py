"""Importance resampling towards a target distribution.

A document's features are its runs of one to three words, hashed to buckets by crc32. Two passes
over the texts: the first counts the buckets of the corpus (an array per task, summed by Spark), the second scores every
document by the gains of its buckets, taken from one array of ``buckets`` longs. From there on only a row of six
numbers per document is read: a radix selection on the digits of score and doc_id finds the exact key of the last
row drawn (``radix.kth``), and only the drawn rows are range-sorted and ranked.

crc32 is linear, so the checksum of a run follows from those of its words by table lookups in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_bytes
from .radix import kth, sorted_ranks


@dataclass(frozen=True)
class ResampleConfig:
    buckets: int = 10_000
    percent: int = 5  # of the documents long enough
    min_words: int = 20
    seed: int = 42


#: A-Z to lower case; every other byte below 0x80 that is no digit or letter to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


#: Checksum state by low byte: what one further zero byte makes of it.
_BYTE = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)


def _shift_tables(n: int) -> np.ndarray:
    """tables[k, i]: what k further zero bytes make of byte i of a state; (n + 1, 4, 256)."""
    out = np.zeros((n + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for k in range(n):
        out[k + 1] = _BYTE[out[k] & 255] ^ (out[k] >> np.uint32(8))
    return out


class _Words(dict):
    """Checksum of a word, and above it its length, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = crc32(word) | len(word) << 32
        return h


class Checksums:
    """crc32 of the words of a text and of its runs of up to three words joined by a space."""

    LONGEST = 63

    def __init__(self):
        self.known = _Words()
        self.tables = _shift_tables(self.LONGEST + 1)

    def _after(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc(a), len(b) -> the part of crc(a + b) that stems from a."""
        t = self.tables
        return t[n, 0, crc & 255] ^ t[n, 1, crc >> np.uint32(8) & 255] ^ t[n, 2, crc >> np.uint32(16) & 255] ^ t[n, 3, crc >> np.uint32(24)]

    def runs(self, w: list[bytes]) -> np.ndarray:
        """Checksums of all runs of one, two and three consecutive words."""
        if not w:
            return np.zeros(0, np.uint32)
        packed = np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))
        one, size = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        if size.max() > self.LONGEST:  # such words are rare: their texts are hashed run by run
            return np.array([crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)], np.uint32)
        spaced = ~(_BYTE[(~one ^ np.uint32(32)) & 255] ^ (~one >> np.uint32(8)))
        two = self._after(spaced[:-1], size[1:]) ^ one[1:]
        two_spaced = self._after(spaced[:-1], size[1:] + 1) ^ spaced[1:]
        three = self._after(two_spaced[:-1], size[2:]) ^ one[2:]
        return np.concatenate([one, two, three])


def text_buckets(sums: Checksums, data: bytes, buckets: int):
    """Arrays of bucket numbers that together hold every feature of the text once, and its number of words."""
    w = words(data)
    if len(w) <= 60_000:
        return [sums.runs(w) % np.uint32(buckets)], len(w)
    out = []
    for at in range(0, len(w), 50_000):  # a long text in stretches; runs across a cut are taken apart
        out.append(sums.runs(w[at : at + 50_000]) % np.uint32(buckets))
        if at:
            out.append(np.array([crc32(b" ".join(w[i : i + n])) for n in (2, 3) for i in range(at - n + 1, at) if i + n <= len(w)], np.uint32) % np.uint32(buckets))
    return out, len(w)


def _counted(buckets: int):
    """Features by bucket: at most ``buckets`` rows a partition."""

    def run(batches):
        sums, n = Checksums(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for t in texts:
                    for part in text_buckets(sums, t, buckets)[0]:
                        n += np.bincount(part, minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, column: str, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: ``buckets`` sums, whatever the corpus."""
    got = texts.select(text_bytes(f"`{column}`")).mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the two smoothed distributions, bucket by bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(shared, buckets: int):
    def run(batches):
        sums, gain = Checksums(), shared.value
        for batch in batches:
            row, doc = batch.column(0), batch.column(1)
            for at, end, texts in slices(batch.column(2)):
                out = []
                for t in texts:
                    parts, n_words = text_buckets(sums, t, buckets)
                    out.append((n_words, sum(map(len, parts)), int(sum(gain[p].sum() for p in parts))))
                cols = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([row.slice(at, end - at), doc.slice(at, end - at), *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(3))], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs`` (doc_id long, text); ``target`` has text.

    Null and wordless texts have no features and weight 0; texts under ``min_words`` words are scored and never drawn. The
    noise of a document follows from its id, so reruns agree; a null id has that of an empty one and comes after
    all others of its score; of repeated rows each is drawn for itself. Very long texts are read whole, in
    stretches. With an empty target, gains come from the smoothing alone. Empty tables give an empty result; other
    columns are not read."""
    corpus = bucket_counts(docs, "text", cfg.buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains(corpus, bucket_counts(target, "text", cfg.buckets)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    weighed = rows.mapInArrow(_weighed(shared, cfg.buckets), "row long, doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    able = scored.where(F.col("n_words") >= cfg.min_words).select("row", "doc_id", (-F.col("score")).alias("down"))
    drawn = able.where(kth(able, ["down", "doc_id", "row"], cfg.percent * able.count() // 100))
    ranked = sorted_ranks(drawn, [F.col("down"), F.col("doc_id").asc_nulls_last(), F.col("row")], "resample-drawn")
    ranked = ranked.select("row", (F.col("rank") + 1).alias("rank"))
    return scored.join(ranked, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
