"""Quality classifier: a byte-level convolutional network in numpy.

``filters`` filters of ``width`` bytes slide over every position of the UTF-8 bytes of a text. The
text is covered by chunks of four blocks of 64 bytes that overlap by one block; each filter
is max-pooled within a chunk, passed through a ramp, and the chunk vectors of the whole
document are combined - their mean and their maximum - by a logistic unit into one probability.

Since the input is one of 256 symbols, a filter is a table (position in the filter, byte), and two
positions at a time are looked up in a table of byte pairs: three gathers a position.

Training (Adam on mini-batches, on the driver) takes a bounded sample of labelled rows (``max_docs``),
whole texts with all their chunks, like scoring: a tenth of them calibrates the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fit_logistic, labelled_sample, table, text_bytes

BLOCK, SPAN, STRIDE = 64, 4, 3  # bytes of a block; blocks of a chunk; blocks from chunk to chunk


@dataclass(frozen=True)
class CnnConfig:
    filters: int = 16
    width: int = 6
    max_docs: int = 3000
    train_piece: int = 512  # chunks convolved at once in training
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    piece: int = 1 << 16  # positions convolved at once
    buffer: int = 4_000_000  # bytes of texts laid out at once
    seed: int = 3


def layout(size: int, width: int) -> tuple[int, int]:
    """(chunks, blocks) that cover a text of ``size`` bytes and ``width`` bytes of padding."""
    blocks = max(SPAN, -(-(size + width) // BLOCK))
    chunks = -(-(blocks - SPAN) // STRIDE) + 1
    return chunks, STRIDE * (chunks - 1) + SPAN


@dataclass
class ByteCnn:
    tables: np.ndarray  # (width, 256, filters)
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    out_b: float
    slope: float = 1.0  # calibration
    shift: float = 0.0

    def pairs(self) -> list[np.ndarray]:
        t = self.tables
        return [np.ascontiguousarray((t[j][:, None] + t[j + 1][None]).reshape(65536, -1)) for j in range(0, len(t), 2)]

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = (mean @ self.mean_w + most @ self.max_w + self.out_b) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """Convolves texts; holds the pair tables and buffers of one Python worker."""

    def __init__(self, net: ByteCnn, cfg: CnnConfig):
        self.net, self.cfg, self.tables = net, cfg, net.pairs()
        self.a = np.empty((cfg.piece, cfg.filters), np.float32)
        self.b = np.empty((cfg.piece, cfg.filters), np.float32)

    def block_max(self, buf: np.ndarray) -> np.ndarray:
        """Per block of 64 positions the maximum of every filter; ``buf`` has a spare block."""
        pair = buf[:-1].astype(np.int32) * 256 + buf[1:]
        n = len(buf) - BLOCK
        out = np.empty((n // BLOCK, self.cfg.filters), np.float32)
        for at in range(0, n, self.cfg.piece):
            m = min(self.cfg.piece, n - at)
            total, part = self.a[:m], self.b[:m]
            np.take(self.tables[0], pair[at : at + m], axis=0, out=total, mode="clip")
            for k in range(1, len(self.tables)):
                np.take(self.tables[k], pair[at + 2 * k : at + 2 * k + m], axis=0, out=part, mode="clip")
                total += part
            out[at // BLOCK : (at + m) // BLOCK] = total.reshape(m // BLOCK, BLOCK, -1).max(1)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        result, at = np.empty(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) < self.cfg.buffer):
                size += len(texts[end])
                end += 1
            result[at:end] = self._score(texts[at:end])
            at = end
        return result

    def _score(self, texts: list[bytes]) -> np.ndarray:
        plan = [layout(len(t), self.cfg.width) for t in texts]
        chunks, blocks = (np.array(x) for x in zip(*plan, strict=True))
        first = np.cumsum(blocks + 1) - (blocks + 1)  # a spare block apart: no filter reaches the next text
        buf = np.zeros((int((blocks + 1).sum()) + 1) * BLOCK, np.uint8)
        for t, f in zip(texts, first, strict=True):
            buf[f * BLOCK : f * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
        peak = self.block_max(buf)
        chunk_first = np.cumsum(chunks) - chunks
        start = np.repeat(first, chunks) + STRIDE * (np.arange(chunks.sum()) - np.repeat(chunk_first, chunks))
        vec = np.maximum(np.maximum.reduce([peak[start + k] for k in range(SPAN)]) + self.net.bias, 0)
        mean = np.add.reduceat(vec, chunk_first, axis=0) / chunks[:, None]
        return self.net.probability(mean, np.maximum.reduceat(vec, chunk_first, axis=0))


def train(docs: list[np.ndarray], labels: np.ndarray, cfg: CnnConfig) -> ByteCnn:
    """docs: the padded bytes of each document, a whole number of chunks."""
    rng = np.random.default_rng(cfg.seed)
    size, span = cfg.filters, SPAN * BLOCK
    net = ByteCnn(rng.normal(0, 0.05, (cfg.width, 256, size)).astype(np.float32), np.zeros(size, np.float32), rng.normal(0, 0.1, size).astype(np.float32), rng.normal(0, 0.1, size).astype(np.float32), 0.0)
    if len({*labels.tolist()}) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.5
        net.slope, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    # every tenth document is for calibration
    held = np.arange(len(docs)) % 10 == 9 if len(docs) >= 200 else np.zeros(len(docs), bool)
    used = np.flatnonzero(~held)
    params = {"t": net.tables, "b": net.bias, "m": net.mean_w, "x": net.max_w, "o": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    balance = np.array([0.5 / max(1e-6, np.mean(labels == c)) for c in (0, 1)])
    step = 0

    def forward(which):
        each = [chunks_of(docs[i], cfg) for i in which]
        n = np.array([len(c) for c in each])
        tables, wheres, peaks, x = net.pairs(), [], [], np.concatenate(each)
        for low in range(0, len(x), cfg.train_piece):
            part = x[low : low + cfg.train_piece]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            conv = tables[0][pair[:, :span]]
            for k in range(1, len(tables)):
                conv += tables[k][pair[:, 2 * k : 2 * k + span]]
            wheres.append(conv.argmax(1))
            peaks.append(np.take_along_axis(conv, wheres[-1][:, None], 1)[:, 0])
        where, vec = np.concatenate(wheres), np.maximum(np.concatenate(peaks) + net.bias, 0)
        heads = np.cumsum(n) - n
        return x, n, heads, where, vec, np.add.reduceat(vec, heads, axis=0) / n[:, None], np.maximum.reduceat(vec, heads, axis=0)

    for _ in range(cfg.epochs):
        order = rng.permutation(used)
        for low in range(0, len(order), cfg.batch):
            which = order[low : low + cfg.batch]
            x, n, heads, where, vec, mean, most = forward(which)
            net.out_b = float(params["o"][0])
            y = labels[which]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.mean_w + most @ net.max_w + net.out_b, -30, 30)))
            d = ((p - y) * balance[y.astype(int)] / len(which)).astype(np.float32)
            row = np.repeat(np.arange(len(which)), n)
            dv = d[row, None] * net.mean_w / n[row, None]
            top = vec == most[row]
            dv = (dv + top * d[row, None] * net.max_w) * (vec > 0)
            grad = {"m": mean.T @ d + 1e-3 * net.mean_w, "x": most.T @ d + 1e-3 * net.max_w, "o": np.array([d.sum()], np.float32), "b": dv.sum(0)}
            g = np.zeros_like(net.tables)
            chunk, filt = np.nonzero(dv)
            for j in range(cfg.width):
                np.add.at(g[j], (x[chunk, where[chunk, filt] + j], filt), dv[chunk, filt])
            grad["t"] = g + 1e-5 * net.tables
            step += 1
            for k, v in params.items():
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.001 * (grad[k] ** 2 - second[k])
                v -= (cfg.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.out_b = float(params["o"][0])
    # the classes were balanced in training; a logistic curve brings back the true share
    check = np.flatnonzero(held) if held.any() and len({*labels[held].tolist()}) == 2 else used
    logit = np.concatenate([(f[5] @ net.mean_w + f[6] @ net.max_w + net.out_b) for f in (forward(check[i : i + 200]) for i in range(0, len(check), 200))])
    slope, shift = fit_logistic(logit, labels[check], l2=1.0)
    net.slope, net.shift = float(slope[0]), shift
    return net


def padded(data: bytes, cfg: CnnConfig) -> np.ndarray:
    """A text and the padding that its chunks and the last filter need."""
    _, blocks = layout(len(data), cfg.width)
    buf = np.zeros(blocks * BLOCK + cfg.width, np.uint8)
    buf[: len(data)] = np.frombuffer(data, np.uint8)
    return buf


def chunks_of(buf: np.ndarray, cfg: CnnConfig) -> np.ndarray:
    """All chunks of a padded text, each with the bytes that filters at its end reach: a view."""
    return np.lib.stride_tricks.sliding_window_view(buf, SPAN * BLOCK + cfg.width)[:: STRIDE * BLOCK]


def fit(documents: DataFrame, labels: DataFrame, keep: Column, cfg: CnnConfig = CnnConfig(), label: str = "quality") -> ByteCnn:
    """Learn from labelled documents for which ``keep`` (a condition on doc_id) holds. Null texts are
    empty; of equal texts one is taken; labels of one class give their share to every text."""
    sample = labelled_sample(documents, labels, label, keep, cfg.max_docs, "cnn")

    rows = sample.select("doc_id", text_bytes("text").alias("x"), "label").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return train([padded(bytes(r["x"]), cfg) for r in rows], np.array([float(r["label"] > 0) for r in rows]), cfg)


def score_column(spark: SparkSession, net: ByteCnn, cfg: CnnConfig = CnnConfig(), text: str | Column = "text") -> Column:
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(data: pd.Series) -> pd.Series:
        net = shared.value
        scorer = net.__dict__.setdefault("_scorer", None) or Scorer(net, cfg)
        net._scorer = scorer  # the pair tables are made once a worker
        return pd.Series(scorer.score(data.tolist()) if len(data) else [], dtype=float)

    return score(text_bytes(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, null and repeated ids included. Null and empty texts are scored as
    padding only; very long texts are scored whole; without labels every score is about 0.5; an
    empty table gives an empty result; other columns are not read."""
    documents = table(spark, sf_dir, "documents")
    net = fit(documents, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = documents.select("doc_id", score_column(spark, net).alias("score"))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
