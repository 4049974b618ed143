"""LM scoring: a hidden Markov language model.

A text is a sequence of words (A-Z in lower case) and one end. The alphabet of the chain is
bounded: the ``symbols`` most frequent words are symbols of their own, the end is one, and all
other words fall into ``buckets`` classes by their last bytes. A word of a class is emitted in two
steps, the class by the hidden state and the word within the class by its smoothed share of
the class's training tokens, whose counts cover the whole corpus:

    P(text) = sum over state paths of prod P(state) P(symbol | state)  *  prod P(word | class)

All counts are exact: one table holds every word of the training texts with its count. Words with at
least ``share`` of the training tokens, fewer than 1 / ``share`` of them, are broadcast; every other
occurrence is joined with the table, and none of those words is hot in the training texts.

Training is Baum-Welch. Expected counts are gathered per partition and summed by symbol in
a shuffle, so that only the parameters (states x symbols) reach the driver. Every round reads all
training documents, whatever their number; rounds end when the likelihood hardly climbs any more.
The likelihood is exact: a scaled forward recursion over every whole text.

``base_score`` is the add-half unigram model on the same counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lower_words, materialize, slices, table, text_bytes


@dataclass(frozen=True)
class HmmConfig:
    states: int = 8
    symbols: int = 8192
    buckets: int = 256
    share: float = 1e-6  # words with this share of the training tokens are broadcast
    rounds: int = 14  # of Baum-Welch, at most
    least_rounds: int = 8  # the states part slowly at first
    gain: float = 1e-3  # later rounds end when the log-likelihood climbs by less than this share
    block: int = 600_000  # tokens worked on at once
    seed: int = 17

    @property
    def end(self) -> int:
        return self.symbols

    @property
    def alphabet(self) -> int:
        return self.symbols + 1 + self.buckets


def _counted(batches):
    """Per partition: words and how often they occur."""

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    counts: Counter = Counter()
    for b in batches:
        for _, _, texts in slices(b.column(0)):
            for w in map(lower_words, texts):
                counts.update(w)
                if len(counts) > 400_000:
                    yield out(counts)
                    counts = Counter()
    yield out(counts)


@dataclass
class Lexicon:
    """The frequent words: symbols, and by hash the counts of the others."""

    symbols: dict[bytes, int]
    hashes: np.ndarray  # sorted
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], counts: list[int], cfg: HmmConfig) -> Lexicon:
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        by_hash = np.argsort(h)
        return cls({words[i]: s for s, i in enumerate(order[: cfg.symbols])}, h[by_hash], np.array(counts, np.int64)[by_hash])

    def count(self, words: list[bytes]) -> np.ndarray:
        """The counts of frequent words, 0 for any other."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


class _Codes(dict):
    """Word -> place in arrays of symbols, logarithms of counts, and whether the word is rare. New words get a place when
    they are met; ``learn`` fills the places of all of them at once."""

    def __init__(self, lexicon: Lexicon, cfg: HmmConfig):
        super().__init__()
        self.lexicon, self.cfg = lexicon, cfg
        self.forget()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def learn(self) -> None:
        new, cfg = self.new, self.cfg
        s = np.fromiter(map(self.lexicon.symbols.get, new, repeat(-1)), np.int64, len(new))
        own = s >= 0
        c = self.lexicon.count(new)
        kind = cfg.symbols + 1 + np.fromiter((crc32(w[-3:]) for w in new), np.int64, len(new)) % cfg.buckets
        self.symbol = np.concatenate([self.symbol, np.where(own, s, kind).astype(np.uint16)])
        self.log = np.concatenate([self.log, np.where(own | (c == 0), 0.0, np.log10(c + 0.5))])
        self.rare = np.concatenate([self.rare, ~own & (c == 0)])
        self.new = []

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.symbol, self.log, self.rare = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, bool)


TOKENS = "train boolean, symbols binary, near_log double, near_known long, rare array<binary>"


def _encode(shared, cfg: HmmConfig):
    def run(batches):
        codes = _Codes(shared.value, cfg)
        for b in batches:
            for at, end, texts in slices(b.column(3)):
                if len(codes) > 300_000:
                    codes.forget()
                words, n = [*map(lower_words, texts)], len(texts)
                size = np.fromiter(map(len, words), np.int64, n)
                flat = [*chain.from_iterable(words)]
                code = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
                codes.learn()
                symbol, rare, row = codes.symbol[code], codes.rare[code], np.repeat(np.arange(n), size)
                ends = np.concatenate([[0], np.cumsum(size + 1)])  # an end follows the words of each text
                symbols = np.full(ends[-1], cfg.end, "<u2")
                symbols[np.arange(len(flat)) + row] = symbol
                near = (symbol > cfg.end) & ~rare
                far = np.flatnonzero(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(at, end - at) for i in range(3)),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(symbols)]),
                        pa.array(np.bincount(row, codes.log[code], n)),
                        pa.array(np.bincount(row[near], minlength=n)),
                        pa.ListArray.from_arrays(np.searchsorted(row[far], np.arange(n + 1)).astype(np.int32), pa.array([flat[i] for i in far.tolist()], pa.binary())),
                    ],
                    names=["row_id", "doc_id", "train", "symbols", "near_log", "near_known", "rare"],
                )

    return run


@dataclass
class Params:
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray  # (alphabet, states)

    def single(self) -> Params:
        """In single precision, for expected counts: every step is scaled, so errors do not add up."""
        return Params(*(x.astype(np.float32) for x in (self.start, self.moves, self.emit)))


def time_major(seqs: list[np.ndarray], block: int):
    """Yields (rows, symbols, offsets, active): sequences sorted by length, longest first, cut
    into blocks; step t of all sequences that have one is symbols[offsets[t]:][:active[t]]."""
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    low = 0
    while low < len(order):
        high, size = low, 0
        while high < len(order) and (size == 0 or size + len(seqs[order[high]]) <= block):
            size += len(seqs[order[high]])
            high += 1
        rows = order[low:high]
        lengths = np.array([len(seqs[i]) for i in rows])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        offsets = np.concatenate([[0], np.cumsum(active)])
        step = np.concatenate([np.arange(n) for n in lengths])
        symbols = np.empty(size, np.int64)
        symbols[offsets[step] + np.repeat(np.arange(len(rows)), lengths)] = np.concatenate([seqs[i] for i in rows])
        yield rows, symbols, offsets, active
        low = high


def forward(symbols, offsets, active, p: Params):
    """Scaled forward probabilities, the scales of every step, log likelihood by sequence. What need not go
    step by step is done for all steps at once."""
    b = p.emit[symbols]
    alpha, scale, one = np.empty_like(b), np.empty(len(symbols), b.dtype), np.ones(len(p.start), b.dtype)
    bounds, last = offsets.tolist(), 0
    for t, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        here, c = alpha[i:j], scale[i:j]
        if t:
            np.matmul(alpha[last : last + j - i], p.moves, out=here)
            here *= b[i:j]
        else:
            np.multiply(b[i:j], p.start, out=here)
        np.matmul(here, one, out=c)
        here /= c[:, None]
        last = i
    row = np.arange(len(symbols)) - np.repeat(offsets[:-1], active)
    return b, alpha, scale, np.bincount(row, np.log(scale), active[0])


def expected(seqs: list[np.ndarray], p: Params, block: int):
    """Baum-Welch counts: (start, moves, emit, log likelihood), added up in double precision; what a step
    computes has that of ``p``."""
    k = len(p.start)
    start, moves, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(p.emit.shape), 0.0
    back = np.ascontiguousarray(p.moves.T)
    for _, symbols, offsets, active in time_major(seqs, block):
        b, alpha, scale, log = forward(symbols, offsets, active, p)
        total += log.sum()
        b /= scale[:, None]
        beta, bounds = np.ones_like(b), offsets.tolist()
        for t in range(len(active) - 1, 0, -1):
            # b becomes what lies ahead of the step before
            i, j, low = bounds[t], bounds[t + 1], bounds[t - 1]
            ahead = b[i:j]
            ahead *= beta[i:j]
            np.matmul(ahead, back, out=beta[low : low + j - i])
        first = bounds[1]
        before = np.arange(first, len(symbols)) - np.repeat(active[:-1], active[1:])
        for i in range(0, len(before), 100_000):
            at = before[i : i + 100_000]
            moves += alpha[at].T @ b[first + i : first + i + len(at)]
        alpha *= beta
        start += alpha[: active[0]].sum(0, dtype=float)
        for s in range(k):
            emit[:, s] += np.bincount(symbols, alpha[:, s], len(emit))
    return start, moves * p.moves, emit, total


def _expect(shared, cfg: HmmConfig):
    def run(batches):
        p = shared.value.single()
        k = cfg.states
        start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((cfg.alphabet, k))
        log = 0.0
        for b in batches:
            s, m, e, x = expected([np.frombuffer(v, "<u2") for v in b.column(0).to_pylist()], p, cfg.block)
            start, moves, emit, log = start + s, moves + m, emit + e, log + x
        seen = np.flatnonzero(emit.sum(1) > 0)
        keys = np.concatenate([seen, -1 - np.arange(k), [-1 - k], [-2 - k]])
        rows = np.concatenate([emit[seen], moves, start[None], np.full((1, k), log / k)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(rows[:, i]) for i in range(k))], names=["key", *(f"g{i}" for i in range(k))])

    return run


def baum_welch_round(tokens: DataFrame, p: Params, unigram: np.ndarray, cfg: HmmConfig) -> tuple[Params, float]:
    """One round over the given rows: counts by partition, summed by symbol, then normalised
    with a little of the unigram distribution as prior."""
    k = cfg.states
    shared = tokens.sparkSession.sparkContext.broadcast(p)
    cols = ", ".join(f"g{i} double" for i in range(k))
    sums = tokens.select("symbols").mapInArrow(_expect(shared, cfg), f"key long, {cols}").groupBy("key").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(k))).collect()
    emit, moves, start, log = np.zeros((cfg.alphabet, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for r in sums:
        row = np.array(r[1:])
        if r[0] >= 0:
            emit[r[0]] = row
        elif r[0] >= -k:
            moves[-1 - r[0]] = row
        elif r[0] == -1 - k:
            start = row
        else:
            log = row.sum()
    emit += 1.0 * unigram[:, None]
    moves, start = moves + 0.1, start + 0.1
    return Params(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)), float(log)


def _score(shared, cfg: HmmConfig):
    def run(batches):
        p, log_word, log_class = shared.value
        for b in batches:
            seqs = [np.frombuffer(v, "<u2").astype(np.int64) for v in b.column(2).to_pylist()]
            log = np.zeros(len(seqs))
            for rows, symbols, offsets, active in time_major(seqs, cfg.block):
                log[rows] = forward(symbols, offsets, active, p)[3]
            log /= np.log(10)
            log += [log_class[s].sum() for s in seqs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in seqs], pa.int64()), pa.array([int((s < cfg.end).sum()) for s in seqs], pa.int64()), pa.array([float(log_word[s].sum()) for s in seqs]), pa.array(log), b.column(3), b.column(4)],
                names=["row_id", "doc_id", "n_tokens", "n_hot", "hot_log", "model_log", "near_log", "near_known"],
            )

    return run


def score_texts(docs: DataFrame, train: Column, cfg: HmmConfig = HmmConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Null texts are empty (one token, the end). Without training rows every known count is zero
    and the untrained chain scores. Null and repeated ids and repeated rows are scored each; very long texts are
    scored whole; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text_bytes(text_col).alias("text"))
    counted = materialize(rows.where("train").select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "hmm-counts")
    ends = rows.where("train").count()
    v, n = counted.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends
    frequent = counted.where(F.col("c") >= max(1.0, cfg.share * n)).toArrow()
    lexicon = Lexicon.of(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), cfg)
    shared = spark.sparkContext.broadcast(lexicon)
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "train", "text")
    tokens = materialize(numbered.mapInArrow(_encode(shared, cfg), f"row_id long, doc_id {kind}, {TOKENS}"), "hmm-tokens")

    # occurrences of all other words take their counts by a join
    rare = tokens.select("row_id", F.explode("rare").alias("word")).join(counted, "word", "left")
    rare = rare.groupBy("row_id").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"))
    rare = materialize(rare, "hmm-rare")

    # training tokens of every symbol, and different training words of every class
    counts, types = np.zeros(cfg.alphabet), np.zeros(cfg.buckets)
    for r in counted.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % cfg.buckets).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("t")).collect():
        counts[cfg.symbols + 1 + r["k"]], types[r["k"]] = r["c"], r["t"]
    for (w, s), c in zip(lexicon.symbols.items(), lexicon.count([*lexicon.symbols]), strict=True):
        k = crc32(w[-3:]) % cfg.buckets
        counts[s] = c
        counts[cfg.symbols + 1 + k] -= counts[s]
        types[k] -= 1
    counts[cfg.end] = ends

    unigram = (counts + 0.5) / (n + 0.5 * cfg.alphabet)
    rng = np.random.default_rng(cfg.seed)
    k = cfg.states
    emit = unigram[:, None] * np.exp(rng.normal(0, 1.0, (cfg.alphabet, k)))
    moves = np.full((k, k), 1.0) + 10 * np.eye(k) + rng.random((k, k)) * 0.1
    p = Params(np.full(k, 1 / k), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
    training, last = tokens.where("train"), -np.inf
    for i in range(cfg.rounds if n else 0):
        p, log = baum_welch_round(training, p, unigram, cfg)
        if i >= cfg.least_rounds and log - last < cfg.gain * abs(log):
            break
        last = log

    log_word = np.log10(counts + 0.5)
    log_word[cfg.end + 1 :] = 0.0  # those come with the words
    log_class = np.zeros(cfg.alphabet)
    log_class[cfg.end + 1 :] = -np.log10(counts[cfg.end + 1 :] + 0.5 * (types + 1))
    shared = spark.sparkContext.broadcast((p, log_word, log_class))
    scored = tokens.select("row_id", "doc_id", "symbols", "near_log", "near_known").mapInArrow(
        _score(shared, cfg), f"row_id long, doc_id {kind}, n_tokens long, n_hot long, hot_log double, model_log double, near_log double, near_known long"
    )
    out = scored.join(rare, "row_id", "left").withColumns({"tail_log": F.col("near_log") + F.coalesce("rare_log", F.lit(0.0)), "tail_known": F.col("near_known") + F.coalesce("rare_known", F.lit(0))})
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_hot") + F.col("tail_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        (F.col("model_log") + F.col("tail_log")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
