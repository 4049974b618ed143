"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by a benchmark item of L words if some stretch of it is within
k = floor(``share`` * L) word insertions, deletions and substitutions of the item.

1. *Windows.* Cut an item into k + 1 pieces: with at most k edits one piece survives whole. So
   a window of the item's size is looked at wherever a three-word key of some piece occurs,
   placed as the piece lies in the item. Nothing that qualifies is lost by this.
2. *CGK embedding.* A pointer walks over the window; at step j it writes the word under it and
   moves on if the j-th random function of that word says so. Two sequences a few edits apart
   fall into step again, so that edit distance becomes Hamming distance.
3. *Bit-sampling LSH.* Each of ``repeats`` walks is sampled at ``sampled`` steps; a window and an
   item (of that size) that agree there in any repeat are candidates.
4. *Verification.* A dynamic program finds the least edit distance of the item to any stretch of
   the document around the window.

Words are runs of letters and digits in lower case (Unicode). Items of fewer words than a key has allow no
edits and are looked up as they are; null items and items without words are never found.

Benchmarks are taken in blocks of ``block`` items, one pass over the documents for each: only one
block is broadcast and held by the workers at a time. Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

Q = 3  # words of a key
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class DecontamConfig:
    share: float = 0.2
    repeats: int = 32
    sampled: int = 2
    block: int = 5000
    seed: int = 7


def allowed_edits(n: int, share: float) -> int:
    """k, kept so small that each of the k + 1 pieces has Q words."""
    return max(0, min(int(share * n + 1e-9), n // Q - 1))


def best_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of ``item`` to any stretch of ``text`` (possibly an empty one)."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for w in item:
        up = row + 1
        up[1:] = np.minimum(up[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(up - steps) + steps
    return int(row.min())


class ItemIndex:
    """One block of items, ready for lookups; its size is bounded by the block."""

    def __init__(self, items: list[tuple[int, str]], cfg: DecontamConfig):
        self.cfg = cfg
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.short: dict[tuple[str, ...], set[int]] = defaultdict(set)  # fewer words than a key
        for item_id, data in items:
            w = words_of(data)
            if 0 < len(w) < Q:
                self.short[tuple(w)].add(item_id)
            elif w:
                ids = np.array([self.words.setdefault(x, len(self.words) + 1) for x in w], np.int64)
                self.items.append((item_id, ids, allowed_edits(len(w), cfg.share)))
        size = len(self.words) + 1
        spelled = {i: w for w, i in self.words.items()}
        at: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for _, ids, k in self.items:
            cuts = np.linspace(0, len(ids), k + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # of the keys in a piece, the one of the longest words is met least by chance
                p = max(range(a, b - Q + 1), key=lambda i: (sum(len(spelled[x]) for x in ids[i : i + Q]), -i))
                at[int(ids[p] * size * size + ids[p + 1] * size + ids[p + 2])].add((len(ids), int(p)))
        self.size = size
        self.keys = np.array(sorted(at), np.int64)
        self.places = [sorted(at[k]) for k in sorted(at)]
        rng = np.random.default_rng(cfg.seed)
        longest = max((len(ids) for _, ids, _ in self.items), default=1)
        self.mul = rng.integers(1, 2**31, (3 * longest, cfg.repeats), dtype=np.int64) * 2 + 1
        self.add = rng.integers(0, 2**31, (3 * longest, cfg.repeats), dtype=np.int64)
        self.samples = {}
        self.lookup: dict[int, dict[tuple[int, int], list[int]]] = {}
        for n in sorted({len(ids) for _, ids, _ in self.items}):
            own = np.random.default_rng([cfg.seed, n])
            self.samples[n] = own.integers(0, 2 * n, (cfg.sampled, cfg.repeats))
            rows = [i for i, x in enumerate(self.items) if len(x[1]) == n]
            keys = self.embed(np.stack([self.items[i][1] for i in rows]))
            buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, k in zip(rows, keys, strict=True):
                for r, x in enumerate(k):
                    buckets[(r, int(x))].append(i)
            self.lookup[n] = dict(buckets)

    def embed(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys, one row per window and one column per repeat."""
        n = windows.shape[1]
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.int64)], 1)
        at = np.zeros((len(windows), self.cfg.repeats), np.int64)
        row = np.arange(len(windows))[:, None]
        out = np.zeros((len(windows), self.cfg.repeats), np.int64)
        sample = self.samples[n]
        for j in range(int(sample.max()) + 1):
            x = padded[row, at]
            for s in range(self.cfg.sampled):
                hit = sample[s] == j
                if hit.any():
                    out[:, hit] = out[:, hit] * 1_000_003 + x[:, hit] * (2 * s + 1)
            h = (x * self.mul[j] + self.add[j]) & 0xFFFFFFFF
            at = np.minimum(at + ((h ^ (h >> 15)) >> 11 & 1), n)
        return out

    def find(self, data: str) -> list[int]:
        """Ids of the items found in a text, in order."""
        words = words_of(data)
        exact: set[int] = set()
        if self.short:
            for n in range(1, Q):
                for gram in zip(*(words[i:] for i in range(n)), strict=False):
                    exact |= self.short.get(gram, set())
        return sorted(exact | self._long(words))

    def _long(self, words: list[str]) -> set[int]:
        if not self.items or len(words) < Q:
            return set()
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        spots = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        if not len(spots):
            return set()
        key = (a[spots] * self.size + b[spots]) * self.size + c[spots]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        starts: dict[int, set[int]] = defaultdict(set)
        for p, i in zip(spots[self.keys[at] == key], at[self.keys[at] == key], strict=True):
            for n, offset in self.places[i]:
                starts[n].add(int(p) - offset)
        found: set[int] = set()
        for n, where in starts.items():
            order = sorted(where)
            for part in range(0, len(order), 2000):
                found |= self._windows(ids, n, order[part : part + 2000], found)
        return {self.items[i][0] for i in found}

    def _windows(self, ids: np.ndarray, n: int, starts: list[int], known: set[int]) -> set[int]:
        spot = np.array(starts)[:, None] + np.arange(n)
        inside = (spot >= 0) & (spot < len(ids))
        windows = np.where(inside, ids[np.clip(spot, 0, len(ids) - 1)], 0)
        found: set[int] = set()
        buckets = self.lookup[n]
        for s, keys in zip(starts, self.embed(windows), strict=True):
            candidates = {i for r, x in enumerate(keys) for i in buckets.get((r, int(x)), ())}
            for i in candidates - known - found:
                _, item, k = self.items[i]
                if best_edits(item, ids[max(0, s - 2 * k) : s + n + 2 * k]) <= k:
                    found.add(i)
        return found


def blocks(benchmark: DataFrame, cfg: DecontamConfig) -> Iterator[list[tuple[int, str]]]:
    """Items with a text, in blocks that the driver holds one at a time."""
    part: list[tuple[int, str]] = []
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        if len(part) == cfg.block:
            yield part
            part = []
    if part:
        yield part


def _finder(shared):
    @F.pandas_udf("string")
    def find(data: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([",".join(map(str, index.find(x))) for x in data], dtype=object)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "item_ids", text_col: str = "text", cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``docs`` and a column ``name``: ids of the items found in the text, ascending, each once, joined
    by commas ('' if none). Between blocks the rows are written to the shared folder."""
    spark, out, last = docs.sparkSession, docs.withColumn(name, F.lit("")), None
    for part in blocks(benchmark, cfg):
        if last is not None:
            out = materialize(out, "leaks")
            last.unpersist()
        last = spark.sparkContext.broadcast(ItemIndex(part, cfg))
        found = _finder(last)(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        out = out.withColumn(name, F.concat_ws(",", F.nullif(F.col(f"`{name}`"), F.lit("")), F.nullif(found, F.lit(""))))
    if last is None:
        return out
    # an id whose rows lie in two blocks is listed once; ids that are numbers come in their order, after all others
    ids = F.filter(F.split(F.col(f"`{name}`"), ","), lambda x: x != "")
    return out.withColumn(name, F.array_join(F.array_sort(F.transform(F.array_distinct(ids), lambda x: F.struct(x.try_cast("long").alias("n"), x.alias("id"))))["id"], ","))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids: one row per row of ``documents``, null and repeated ids included.
    Null and empty texts are clean; very long texts are read whole; without items every
    text is clean; an empty table gives an empty result; other columns are not read."""
    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.when(F.col("item_ids") == "", 0).otherwise(F.size(F.split("item_ids", ","))).cast("long")
    return found.select("doc_id", (F.col("item_ids") != "").alias("contaminated"), n.alias("n_items"), "item_ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. Every row is judged by itself, so null and repeated
    ids stay what they are; null and empty texts stay; all columns of ``docs`` are kept; an empty
    table stays empty."""
    return with_leaks(docs, table(spark, sf_dir, "benchmark"), "__gq_items").where("__gq_items = ''").drop("__gq_items")
