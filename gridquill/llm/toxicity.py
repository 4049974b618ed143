"""Toxicity: class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary labelled text, are
compared. ``c`` are occurrences of a bigram in a class, ``k`` continuation counts (before how many
different words a word stands), * both classes together, D absolute discounts (n1 / (n1 + 2 n2) of
the counts they are taken from):

    shared     P*(w)   = (max(k*(w) - D, 0) + D V / (V + 1)) / N*
    class      P(w)    = (max(k(w) - D, 0) + D types P*(w)) / N
    shared     P*(w|h) = (max(c*(h w) - D, 0) + D types*(h) P*(w)) / c*(h)
    class      P(w|h)  = (max(c(h w) - D, 0) + D types(h) P*(w|h) P(w) / P*(w)) / c(h)

What discounting takes from a class goes to the counts that both classes share, so an expression
rare in one class keeps nearly the same probability in both, and a head that a class has never
seen leaves the shared bigram as it is. Every bigram and word of the labelled texts counts. The counts
and the formulas are DataFrame aggregates and joins.

A text is compared by length-normalised log-likelihoods: the difference of the two per-word
log-likelihoods over the whole text, over its worst stretches of 32 and 8 words and over its
worst 1, 2 and 4 words, of both orders. A few insults in a long text hardly move its mean: the stretches
are there for them. A logistic curve over these figures, fitted by cross-fitting (each labelled text is scored
by models that have not seen its fold), makes them a probability.

Learning takes a bounded sample of labelled rows (``max_docs``); scoring takes every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fit_logistic, labelled_sample, materialize, slices, table, text_bytes

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
START = 0  # stands before the first word of a text; no word has this hash


@dataclass(frozen=True)
class ToxicityConfig:
    max_docs: int = 8000  # labelled rows taken for learning, at most
    folds: int = 3  # of the cross-fitting


def bigram_key(h: Column, w: Column) -> Column:
    """Of two 63-bit hashes: the first turned by 17 bits (in 64, so it may be negative), then both mixed."""
    return F.shiftleft(h, 17).bitwiseOR(F.shiftright(h, 46)).bitwiseXOR(w)


def words_of(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


def word_hash(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) | 1


@dataclass
class ClassPair:
    """Log-likelihood ratios (toxic over ordinary) of both orders. Words are places in ``hashes``
    (sorted; place 0 is the start of a text), anything else is -1; bigrams go by ``bigram_key``."""

    hashes: np.ndarray
    word: np.ndarray  # log P(w) ratio
    head: np.ndarray  # log ratio of the shares that a head leaves to the lower order
    keys: np.ndarray  # of the bigrams, sorted
    bigram: np.ndarray
    unknown: float  # log P(w) ratio of a word that no labelled text holds

    def place(self, word: bytes) -> int:
        h = word_hash(word)
        at = int(np.searchsorted(self.hashes, h))
        return at if at < len(self.hashes) and self.hashes[at] == h else -1

    def ratios(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bigram, word) log ratios of a text given as places."""
        known = ids >= 0
        one = np.where(known, self.word[ids], self.unknown)
        before = np.concatenate([[0], ids[:-1]])
        two = one + np.where(before >= 0, self.head[before], 0.0)
        if len(self.keys):
            h = self.hashes[before]
            key = np.where(known & (before >= 0), (h << 17 | h >> 46) ^ self.hashes[ids], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            two = np.where(self.keys[at] == key, self.bigram[at], two)
        return two, one


class Places(dict):
    """Word -> place, remembered by a Python worker."""

    def __init__(self, pair: ClassPair):
        super().__init__()
        self.pair = pair

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        at = self[word] = self.pair.place(word)
        return at


def _worst(total: np.ndarray, width: int) -> float:
    width = min(width, len(total) - 1)
    return float((total[width:] - total[:-width]).max() / width)


def _top(x: np.ndarray, n: int) -> float:
    n = min(n, len(x))
    return float(np.partition(x, len(x) - n)[len(x) - n :].sum() / n)


FIGURES = 12


def figures(two: np.ndarray, one: np.ndarray) -> list[float]:
    """Per-word log-likelihood differences of a text: the whole of it, its worst stretches and
    words; and the logarithm of its length."""
    if not len(one):
        return [0.0] * FIGURES
    a, b = (np.concatenate([[0.0], np.cumsum(x)]) for x in (two, one))
    n = len(one)
    # a text of one word has no second: it is divided by what was asked for, not by what there is
    few = lambda x, k: _top(x, k) * min(n, k) / k
    return [a[-1] / n, _worst(a, 32), _worst(a, 8), b[-1] / n, _worst(b, 32), _worst(b, 8), float(one.max()), few(one, 2), few(one, 4), few(two, 2), few(two, 4), float(np.log1p(n))]


def _count(batches):
    """Per partition: occurrences of bigrams, by class and fold."""

    def out(seen):
        for (label, fold), c in seen.items():
            pairs = list(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.int64()), pa.array([label] * len(pairs), pa.int32()), pa.array([fold] * len(pairs), pa.int32()), pa.array(list(c.values()), pa.int64())],
                names=["h", "w", "label", "fold", "n"],
            )

    seen: dict[tuple[int, int], Counter] = {}
    for b in batches:
        label, fold = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at, _, texts in slices(b.column(2)):
            for i, text in enumerate(texts, at):
                w = list(map(word_hash, words_of(text)))
                seen.setdefault((label[i], fold[i]), Counter()).update(zip([START, *w], w, strict=False))
                if sum(map(len, seen.values())) > 400_000:
                    yield from out(seen)
                    seen.clear()
    yield from out(seen)


def count_bigrams(rows: DataFrame, folds: int) -> DataFrame:
    """h, w and per class and fold the occurrences n{class}{fold}; rows: label, fold, text bytes."""
    cell = lambda c, f: F.sum(F.when((F.col("label") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{c}{f}")
    counts = rows.select("label", "fold", "text").mapInArrow(_count, "h long, w long, label int, fold int, n long")
    return counts.groupBy("h", "w").agg(*(cell(c, f) for c in (0, 1) for f in range(folds)))


CLASSES = ("o", "t", "s")  # ordinary, toxic, shared


def _occurrences(c: str, folds: int, leave: int) -> Column:
    """Of a bigram in a class, in all folds but ``leave``."""
    classes = {"o": (0,), "t": (1,), "s": (0, 1)}[c]
    return sum((F.col(f"n{k}{f}") for k in classes for f in range(folds) if f != leave), F.lit(0))


def marginals(bigrams: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """What the formulas need of every word and of every head, for each left-out fold (and, as ``folds``,
    for none): continuation counts k of words; occurrences c and different words y of heads.
    One row per word of the sample."""
    grid = [(c, f) for f in range(folds + 1) for c in CLASSES]
    words = bigrams.groupBy("w").agg(*(F.count_if(_occurrences(c, folds, f) > 0).cast("int").alias(f"k{c}{f}") for c, f in grid))
    heads = bigrams.groupBy("h").agg(*(x for c, f in grid for x in (F.sum(_occurrences(c, folds, f)).cast("int").alias(f"n{c}{f}"), F.count_if(_occurrences(c, folds, f) > 0).cast("int").alias(f"y{c}{f}"))))
    return materialize(words, "toxicity-words"), materialize(heads, "toxicity-heads")


def _singles(prefix: str) -> list[Column]:
    return [F.count_if(F.col(f"{prefix}{c}") == n).alias(f"{c}{n}") for c in CLASSES for n in (1, 2)]


def _discounts(row) -> dict[str, float]:
    """n1 / (n1 + 2 n2); a half where the counts are too few to tell."""
    return {c: row[f"{c}1"] / (row[f"{c}1"] + 2 * row[f"{c}2"]) if row[f"{c}1"] and row[f"{c}2"] else 0.5 for c in CLASSES}


def kneser_ney(bigrams: DataFrame, words: DataFrame, heads: DataFrame, folds: int, leave: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(key, bigram), (w, word), (h, head): the log ratios of the module docstring, and that of
    an unknown word, learned from all folds but ``leave``. Words and heads, bounded by the sample,
    are broadcast to the bigrams."""
    g = bigrams.select("h", "w", *(_occurrences(c, folds, leave).alias(f"c{c}") for c in CLASSES)).where("cs > 0")
    words = words.select("w", *(F.col(f"k{c}{leave}").alias(f"k{c}") for c in CLASSES)).where("ks > 0")
    heads = heads.select("h", *(F.col(f"{x}{c}{leave}").alias(f"{x}{c}") for c in CLASSES for x in "ny")).where("ns > 0")
    d2 = _discounts(g.agg(*_singles("c")).first())
    seen = words.agg(*_singles("k"), *(x for c in CLASSES for x in (F.sum(f"k{c}").alias(f"N{c}"), F.count_if(F.col(f"k{c}") > 0).alias(f"T{c}")))).first()
    d1, many, types = _discounts(seen), {c: max(1, seen[f"N{c}"] or 0) for c in CLASSES}, {c: seen[f"T{c}"] or 0 for c in CLASSES}
    v = types["s"]
    base = (F.greatest(F.col("ks") - d1["s"], F.lit(0.0)) + d1["s"] * v / (v + 1)) / many["s"]
    tilt = lambda c: ((F.greatest(F.col(f"k{c}") - d1[c], F.lit(0.0)) / F.col("base") + d1[c] * types[c]) / many[c]) if types[c] else F.lit(1.0)
    words = words.withColumn("base", base).select("w", "base", tilt("o").alias("to"), tilt("t").alias("tt"))
    left = lambda c: d1[c] * types[c] / many[c] if types[c] else 1.0
    share = lambda c: F.when(F.col(f"n{c}") > 0, d2[c] * F.col(f"y{c}") / F.col(f"n{c}")).otherwise(1.0)
    both = g.join(F.broadcast(words), "w").join(F.broadcast(heads), "h")
    both = both.withColumn("shared", (F.greatest(F.col("cs") - d2["s"], F.lit(0.0)) + d2["s"] * F.col("ys") * F.col("base")) / F.col("ns"))
    p = lambda c: F.when(F.col(f"n{c}") > 0, F.greatest(F.col(f"c{c}") - d2[c], F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0) + share(c) * F.col("shared") * F.col(f"t{c}")
    return (
        both.select(bigram_key(F.col("h"), F.col("w")).alias("key"), F.log(p("t") / p("o")).cast("float").alias("bigram")),
        words.select("w", F.log(F.col("tt") / F.col("to")).alias("word")),
        heads.select("h", F.log(share("t") / share("o")).alias("head")),
        float(np.log(left("t") / left("o"))),
    )


def _columns(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def class_pair(*counts) -> ClassPair:
    """The tables of ``kneser_ney`` as sorted arrays: one row per different bigram of the sample."""
    two, one, heads, unknown = kneser_ney(*counts)
    w, log_word = _columns(one)
    hashes = np.union1d([START], w).astype(np.int64)
    word, head = np.zeros(len(hashes)), np.zeros(len(hashes))
    word[np.searchsorted(hashes, w)] = log_word
    h, log_head = _columns(heads)
    head[np.searchsorted(hashes, h)] = log_head
    keys, bigram = _columns(two)
    order = np.argsort(keys)
    keys, bigram = keys[order], bigram[order]
    pa.default_memory_pool().release_unused()
    return ClassPair(hashes, word, head, keys, bigram, unknown)


@dataclass
class ToxicityModel:
    pair: ClassPair
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes], places: Places) -> np.ndarray:
        x = np.array([self._figures(t, places) for t in texts]).reshape(-1, FIGURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))

    def _figures(self, text: bytes, places: Places) -> list[float]:
        return text_figures(self.pair, text, places)


def text_figures(pair: ClassPair, text: bytes, places: Places) -> list[float]:
    w = words_of(text)
    return figures(*pair.ratios(np.fromiter(map(places.__getitem__, w), np.int64, len(w)))) if w else figures(np.zeros(0), np.zeros(0))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the figures, none of the log-likelihood differences negative: more toxic evidence
    never lowers a score, also in texts that the models have learned from, whose figures are
    higher than any in the cross-fitting. The figure of the most negative weight is left out until none is."""
    used = list(range(FIGURES))
    while True:
        w, bias = fit_logistic(x[:, used], y, l2=1.0)
        worst = min((i for i in range(len(used)) if used[i] != FIGURES - 1), key=lambda i: w[i], default=None)
        if worst is None or w[worst] >= 0:
            weights = np.zeros(FIGURES)
            weights[used] = w
            return weights, bias
        del used[worst]


def _measured(shared):
    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        places = Places(shared.value)
        return pd.Series([text_figures(shared.value, t, places) for t in text], dtype=object)

    return measure


def fit(documents: DataFrame, labels: DataFrame, keep: Column, cfg: ToxicityConfig = ToxicityConfig(), label: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents for which ``keep`` (a condition on doc_id) holds.

    Of equal texts one is taken; null texts are empty. Labels of one class only, or none, give
    every text about the share of toxic labels (1/3 without any)."""
    spark = documents.sparkSession
    sample = labelled_sample(documents, labels, label, keep, cfg.max_docs, "toxicity")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(cfg.folds)).cast("int")
    rows = materialize(sample.select((F.col("label") > 0).cast("int").alias("label"), fold.alias("fold"), text_bytes("text").alias("text")), "toxicity-sample")
    bigrams = materialize(count_bigrams(rows, cfg.folds), "toxicity-bigrams")
    words, heads = marginals(bigrams, cfg.folds)
    x, y = [], []
    for f in range(cfg.folds):
        shared = spark.sparkContext.broadcast(class_pair(bigrams, words, heads, cfg.folds, f))

        seen = rows.where(F.col("fold") == f).select(_measured(shared)("text").alias("x"), "label").toPandas()
        x += [list(v) for v in seen["x"]]
        y += seen["label"].tolist()
        shared.destroy()
    y = np.array(y, float)
    pair = class_pair(bigrams, words, heads, cfg.folds, cfg.folds)
    if len({*y.tolist()}) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1.5)
        return ToxicityModel(pair, np.zeros(FIGURES), float(np.log(share / (1 - share))))
    order = np.lexsort(np.array(x).T)  # sums do not depend on the order in which rows came
    weights, bias = fit_curve(np.array(x)[order], y[order])
    return ToxicityModel(pair, weights, bias)


def score_column(spark: SparkSession, model: ToxicityModel, text: str | Column = "text") -> Column:
    """Probability that a text is toxic; the model, bounded by its sample, is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(data: pd.Series) -> pd.Series:
        m = shared.value
        places = m.__dict__.setdefault("_places", Places(m.pair))
        return pd.Series(m.scores(data.tolist(), places), dtype=float)

    return score(text_bytes(text))


def learned_rows() -> Column:
    return crc_mod("doc_id", 5) != 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ids and rows included. Null, empty and wordless texts
    have no evidence and get the score that the curve gives to that; very long texts are scored
    whole; without labels every score is 1/3; an empty table gives an empty result; other
    columns are not read."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), learned_rows())
    scored = documents.select("doc_id", score_column(spark, model).alias("score"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.5 or more go. Every row is judged by itself, so null
    and repeated ids stay what they are, null texts are empty, and all columns of ``docs`` are
    kept; an empty table stays empty. Without labels nothing goes."""
    model = fit(docs, table(spark, sf_dir, "labels"), learned_rows())
    return docs.where(score_column(spark, model) < 0.5)
