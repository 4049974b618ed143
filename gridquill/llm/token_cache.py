"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). Normalised content
(null becomes the empty text; nothing else may change, since any change could change the
count) is joined with it by the digest of the content and the digest of the tokenizer file and
library version. Of the digests it does not hold, one document each is encoded, whole, and the
counts are appended; then every document takes its count from the cache.

Only digests are joined and aggregated; the texts of the misses move once, by a hash of id and digest
together, checked by the digest, so neither a digest that a third of the corpus shares nor null or repeated ids meet in one task.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's file and the library that reads it; a change of either misses."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return hashlib.sha256(Path(path).read_bytes() + f"|{library}|{version(library)}".encode()).hexdigest()


def counter(path: str):
    """Function from texts to token counts; loaded once per Python worker."""
    if path not in _loaded:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    return _loaded[path]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty where none has been written yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per input row. Null and repeated ids and repeated rows keep
    their rows; null texts are empty and have no tokens; very long texts are encoded whole; an empty
    table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    name = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    keyed = materialize(rows.select("doc_id", digest.alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")

    # one document of each missing digest, its smallest id
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == name)
    misses = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "content_digest", "left_anti")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode, out = counter(tokenizer_path), []
        for at in range(0, len(texts), 64):
            out += encode(texts.iloc[at : at + 64].tolist())
        return pd.Series(out, dtype="int64")

    # the key names the id and the text; rows that repeat both lie together and one of them is encoded
    key = lambda i, d: F.xxhash64(i, d).alias("key")
    wanted = misses.select(key("doc_id", "content_digest"), F.col("content_digest").alias("want"))
    fetched = rows.select(key(F.col("doc_id"), digest), digest.alias("have"), "text").join(wanted.hint("shuffle_hash"), "key").where("have = want")
    fetched = fetched.groupBy("key", "have").agg(F.first("text").alias("text")).select(F.col("have").alias("want"), "text")
    fresh = fetched.select(F.col("want").alias("content_digest"), F.lit(name).alias("tokenizer_digest"), count("text").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache_path)

    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == name).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that the join has exchanges of its own: skew handling can split a digest that
    # many documents share
    counts = materialize(counts, "token-counts")
    return keyed.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by piece_bpe_32k.model, with a cache of this run's own (so that a run's figures are
    those of a cold cache)."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
