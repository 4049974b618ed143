"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

The texts of a source, in the order of a hash of their ids, are one stream of words that is cut
into blocks of ``block`` words. A source's target is a number of whole passes over its stream and
a rest, which is a quota of blocks in the source's permuted block order; quotas are exact.

The output shards are the leaves of a binary tree. The root holds the block quotas of all
sources; each node hands half of its blocks to either side, the composition of the left half
being a multivariate-hypergeometric draw (seeded by the node, so reruns agree), down to the leaves.
A leaf thus owns, for each source, a stretch of the permuted block order that is disjoint from
all others'. Within a shard, pieces are put in a hashed order (local shuffle).

A piece is the overlap of a document with a drawn block: a stretch of its words, for a shard. No block is
drawn more than ``passes`` times, so no document exceeds ``passes`` times its size. Blocks of 512 words
hold most documents whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, word_count


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5, 2, 1)  # by source in code-point order, repeating
    share: float = 1.5  # of all sizes
    passes: int = 2  # the most a source is repeated
    block: int = 512  # words of a block, at most
    least_blocks: int = 256  # of a source: a small source is cut finer
    shards: int = 64
    bucket_docs: int = 5000  # documents of one sorting unit of a source, about
    seed: int = 11


def targets(sizes: list[int], cfg: MixConfig) -> list[float]:
    """Target words by source: total times weight share, capped at passes * size, the excess
    reshared by weight among the sources below their cap until none is above."""
    n = len(sizes)
    weight = [cfg.weights[i % len(cfg.weights)] for i in range(n)]
    out = [0.0] * n
    left, open_ = cfg.share * sum(sizes), set(range(n))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if unit * weight[i] >= cfg.passes * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = float(cfg.passes * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def _hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """Blocks of the first kind among ``take``. numpy draws from fewer than 10**9; a larger
    population is dealt into halves, whose shares of the draw are drawn first, so that every size
    has the same distribution up to the even deal of the kinds."""
    if not bad:
        return take
    if max(good, bad, take) < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    half_take = take // 2
    return _hypergeometric(good // 2, bad // 2, min(half_take, good // 2 + bad // 2), rng) + _hypergeometric(good - good // 2, bad - bad // 2, take - min(half_take, good // 2 + bad // 2), rng)


def _draw(quota: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Composition of ``take`` blocks drawn without replacement from ``quota`` by source."""
    out, rest = np.zeros_like(quota), int(quota.sum())
    for i, q in enumerate(quota):
        rest -= int(q)
        if q and take:
            out[i] = _hypergeometric(int(q), rest, take, rng)
        take -= int(out[i])
    return out


def splitting_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block quotas by (shard, source); columns sum to ``quota`` exactly."""
    leaves = np.zeros((shards, len(quota)), np.int64)

    def split(node: int, low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            leaves[low] = own
            return
        mid = (low + high) // 2
        take = int(own.sum()) * (mid - low) // (high - low)
        left = _draw(own, take, np.random.default_rng([seed, node]))
        split(2 * node, low, mid, left)
        split(2 * node + 1, mid, high, own - left)

    split(1, 0, shards, np.asarray(quota, np.int64))
    return leaves


def block_words(size: int, cfg: MixConfig) -> int:
    """Small sources are cut finer, so that a source has at least ``least_blocks`` (or a block is a word)."""
    return max(1, min(cfg.block, size // cfg.least_blocks))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(block: np.ndarray, count: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Place of each block in a permutation of 0..count-1 that depends on ``salt``: a four-round
    Feistel network over the next even number of bits, walked until it falls below ``count``."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = block.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = _mix64(right + _mix64(salt[todo].astype(np.uint64) * np.uint64(4) + np.uint64(r)))
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= count[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """Driver-side facts by source, in code-point order (null last); a few numbers a source."""

    sources: list[str | None]
    sizes: np.ndarray
    target: np.ndarray
    block: np.ndarray
    blocks: np.ndarray
    quota: np.ndarray
    ends: np.ndarray  # by (shard, source): quota of the shards up to it


def make_plan(sized: dict[str | None, int], cfg: MixConfig) -> Plan:
    sources = sorted((s for s in sized if s is not None)) + [s for s in sized if s is None]
    sizes = np.array([sized[s] for s in sources], np.int64)
    target = np.array(targets(sizes.tolist(), cfg))
    block = np.array([block_words(int(x), cfg) for x in sizes], np.int64)
    blocks = -(-sizes // np.maximum(block, 1))
    whole = np.floor(target / np.maximum(sizes, 1) + 1e-12).astype(np.int64)
    rest = np.clip(np.rint((target - whole * sizes) / np.maximum(block, 1)), 0, blocks).astype(np.int64)
    quota = np.where(sizes > 0, np.minimum(whole * blocks + rest, cfg.passes * blocks), 0)
    return Plan(sources, sizes, target, block, blocks, quota, np.cumsum(splitting_tree(quota, cfg.shards, cfg.seed), 0))


def _placed(docs: DataFrame, cfg: MixConfig, id_col: str, text_col: str, source_col: str, row_col: str | None) -> tuple[DataFrame, Plan]:
    """Rows with their place in the stream of their source.

    A source's rows are dealt by hash into buckets of about ``bucket_docs``; a row's offset is
    the sum of the buckets before and of the rows before it in its bucket, so that a hot source
    is as many sorting units as it has rows for."""
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            F.xxhash64(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("order"),
        ),
        "mix-sizes",
    )
    per = sized.groupBy("source").agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect()  # a row per source
    plan = make_plan({r["source"]: r["t"] for r in per}, cfg)
    n = {r["source"]: r["n"] for r in per}
    known = [(s, i, -(-n[s] // cfg.bucket_docs)) for i, s in enumerate(plan.sources)]
    units = spark.createDataFrame(known, "name string, s int, units long")
    rows = sized.join(units, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("bucket", F.pmod(F.col("order"), F.col("units")))
    inside = Window.partitionBy("s", "bucket").orderBy("order", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("s", "bucket").agg(F.sum("size").alias("t")).select("s", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["s", "bucket"])
    return rows.select("row_id", "doc_id", "s", "size", "order", (F.col("offset") + F.col("inside")).alias("at")), plan


def _pieces(plan: Plan, cfg: MixConfig):
    def run(frames):
        for whole in frames:
            for low in range(0, len(whole), 2000):
                part = whole.iloc[low : low + 2000]
                part = part[part["size"] > 0]
                s, size, at = (part[c].to_numpy(np.int64) for c in ("s", "size", "at"))
                width = plan.block[s]
                first, last = at // width, (at + size - 1) // width
                count = last - first + 1
                row = np.repeat(np.arange(len(part)), count)
                block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
                for p in range(cfg.passes):
                    here = plan.quota[s[row]] > p * plan.blocks[s[row]]
                    r, b = row[here], block[here]
                    place = p * plan.blocks[s[r]] + permuted(b, plan.blocks[s[r]], s[r] * cfg.passes + p + cfg.seed * 1_000_003)
                    drawn = place < plan.quota[s[r]]
                    r, b, place = r[drawn], b[drawn], place[drawn]
                    start = np.maximum(b * width[r], at[r]) - at[r]
                    end = np.minimum((b + 1) * width[r], at[r] + size[r]) - at[r]
                    shard = np.empty(len(r), np.int32)
                    for source in np.unique(s[r]):
                        mine = s[r] == source
                        shard[mine] = np.searchsorted(plan.ends[:, source], place[mine], side="right")
                    rank = _mix64(part["order"].to_numpy(np.int64)[r].astype(np.uint64) + b.astype(np.uint64) * np.uint64(31) + np.uint64(p)).astype(np.int64)
                    yield pd.DataFrame({"row_id": part["row_id"].to_numpy()[r], "shard": shard, "rank": rank, "start": start, "words": end - start})

    return run


@dataclass
class Mix:
    rows: DataFrame  # row_id, doc_id, s, size, order, at
    plan: Plan
    pieces: DataFrame  # row_id, shard, rank (local shuffle), start, words


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> Mix:
    """The pieces of the mix: a stretch of ``words`` words from word ``start`` of a row, for a
    shard, in the order of ``rank`` there. Null texts have no words; null sources are one source;
    repeated rows are rows of their own (told apart by ``row_col``, or by numbers given here); very long
    texts are cut at the blocks; an empty table gives no pieces."""
    rows, plan = _placed(docs, cfg, id_col, text_col, source_col, row_col)
    rows = materialize(rows, "mix-rows")
    pieces = rows.select("row_id", "s", "size", "order", "at").mapInPandas(_pieces(plan, cfg), "row_id long, shard int, rank long, start long, words long")
    return Mix(rows, plan, pieces)


def taken(m: Mix) -> DataFrame:
    """row_id, doc_id, size, source_size, target, taken, n_pieces, n_shards for every row."""
    facts = m.rows.sparkSession.createDataFrame([(i, int(a), float(t)) for i, (a, t) in enumerate(zip(m.plan.sizes, m.plan.target, strict=True))], "s int, source_size long, target double")
    sums = m.pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.count("*").alias("n_pieces"), F.size(F.collect_set("shard")).alias("n_shards"))
    out = m.rows.join(sums, "row_id", "left").join(facts, "s")
    return out.select("row_id", "doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_pieces", "n_shards")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, null and repeated ids included. Null and wordless texts have size 0
    and give nothing; null sources are one source; very long texts may give a part; an empty
    table gives an empty result; other columns are not read. n_pieces and n_shards say where the words go."""
    return taken(mix(table(spark, sf_dir, "documents"))).drop("row_id")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text_at: int):
    """Texts of pieces: the words [start, start + words) of a row's text with the space between them."""

    def run(batches):
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            out_rows, texts, shard, rank, start, words = [], [], [], [], [], []
            for i, (text, pieces) in enumerate(zip(columns[text_at].to_pylist(), columns[-1].to_pylist(), strict=True)):
                at = [m.span() for m in _WORDS.finditer(text)]
                for p in pieces:
                    out_rows.append(i)
                    texts.append(text[at[p["start"]][0] : at[p["start"] + p["words"] - 1][1]])
                    for to, k in ((shard, "shard"), (rank, "rank"), (start, "start"), (words, "words")):
                        to.append(p[k])
            take = pa.array(out_rows, pa.int64())
            arrays = [pa.array(texts, pa.string()) if i == text_at else c.take(take) for i, c in enumerate(columns[:-1])]
            arrays += [pa.array(shard, pa.int32()), pa.array(rank, pa.int64()), pa.array(start, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "shard", "rank", "start", "words"])

    return run


OWN = ("size", "source_size", "target", "taken", "shard", "rank", "start", "words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the mix itself, a row per piece, repeats included. ``text`` holds the words of
    the piece and n_chars (where there is such a column) its length; shard and rank give its place in the
    output, start and words its place in the document, size, source_size, target and taken the
    document's figures.

    Rows are told apart by a number, so null and repeated ids and repeated rows are mixed each;
    null and wordless texts give nothing; other columns are kept, but for those named like one of
    the stage's own, which it replaces; an empty table gives an empty mix."""
    kept = [c for c in docs.columns if c not in OWN]
    base = materialize(docs.select(F.monotonically_increasing_id().alias("__gq_row"), *(F.col(f"`{c}`") for c in kept)), "mix-docs")
    m = mix(base, row_col="__gq_row")
    m.pieces = materialize(m.pieces, "mix-pieces")
    figures = taken(m).where("taken > 0").select(F.col("row_id").alias("__gq_row"), *OWN[:4])
    each = m.pieces.groupBy(F.col("row_id").alias("__gq_row")).agg(F.sort_array(F.collect_list(F.struct("start", "shard", "rank", "words"))).alias("__gq_pieces"))
    whole = base.join(figures, "__gq_row").join(each, "__gq_row").drop("__gq_row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema if f.name != "__gq_pieces")
    out = whole.mapInArrow(_cut(whole.columns.index("text")), schema + ", shard int, rank long, start long, words long")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept else out
