"""Quality rules: a linear-chain conditional random field over lines.

Every line with a word gets a vector of cheap features (how many words, shares of symbols,
digits, letters, how it ends, whether it repeats an earlier line, how many of its words do so ...) and
the weights of its words, which are hashed to ``BUCKETS`` and count 1 / sqrt(words of the line) each. A
two-state linear-chain CRF scores labels and transitions; Viterbi decoding marks each line content or
boilerplate. The share of a document's words in content lines decides whether it is kept; the base
rules (too short, too repetitive) come first.

*Line labels* inside the labelled documents are distant: a *common line* is boilerplate, another line of a
document of quality 1 is content, one of quality 0 boilerplate. Documents thus hold both labels and
the transitions learn where one gives way to the other. No feature says whether a line is common: that is
known of the labelled lines only, so a boilerplate line which nobody has seen is judged like any other. The
content share from which documents are kept is the one that parts the labelled documents best.

*Common lines* are those lines of the labelled documents that stand in at least ``common_least`` different
surroundings (the first three words of the line before and of the line after it), if half of their
occurrences have surroundings of their own. So licenses and slogans are common, the lines of a
document that was copied a thousand times are not. Occurrences are counted over all lines of all documents;
the bar is the same for a corpus of any size. What is broadcast are the hashes of the sample's lines.

Training is iterative parameter mixing: in each round every partition of the labelled lines takes
gradient steps from the common parameters, and the results are averaged by number of documents, a word's over the
partitions that hold it; the averages are a Spark aggregation, so the driver gets each parameter once.
It takes a bounded sample of labelled documents (``max_docs``), whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, materialize, slices, table, text_bytes

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_REST = re.compile(rb"[\x20\x09-\x0D]")
_DIGITS = re.compile(rb"[0-9]")
_UPPER = re.compile(rb"[A-Z]")
_STOPS = re.compile(rb"[.!?]")
FEATURES = 16
BUCKETS = 1 << 14  # of words
DENSE = 2 * FEATURES + 6  # parameters before those of the words
FIXED = 1 << 30


@dataclass(frozen=True)
class CrfConfig:
    max_docs: int = 4000  # labelled documents taken for training, at most
    common_least: int = 5  # surroundings of a common line, at least
    rounds: int = 6  # of parameter mixing
    steps: int = 30  # gradient steps of a partition in a round
    parts: int = 8  # partitions of the labelled lines
    rate: float = 0.5
    l2: float = 1e-3
    word_rate: float = 0.3
    word_l2: float = 3e-5


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 2)))  # of words
    content_share: float = 0.5  # of the words: kept from there on


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip()) >> 1


def _surroundings(shared):
    """Per partition: (line, surroundings) of the lines in ``shared`` (sorted hashes; None: all with a
    word), and how many documents have them."""

    def out(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["line", "around", "n"])

    def run(batches):
        wanted = None if shared is None else {*shared.value.tolist()}
        seen: Counter = Counter()
        for b in batches:
            for _, _, texts in slices(b.column(0)):
                for data in texts:
                    lines = [x for x in data.split(b"\n") if x.strip()]
                    found = [(h, i) for i, h in enumerate(map(line_hash, lines)) if wanted is None or h in wanted]
                    near = lambda i, lines=lines: b" ".join(lines[i].split(None, 3)[:3]) if 0 <= i < len(lines) else b""
                    seen.update({(h, xxhash.xxh3_64_intdigest(near(i - 1) + b"\n" + near(i + 1)) >> 1) for h, i in found})
                    if len(seen) > 300_000:
                        yield out(seen)
                        seen.clear()
        yield out(seen)

    return run


def common_lines(documents: DataFrame, cfg: CrfConfig = CrfConfig(), text: str = "text", among: np.ndarray | None = None) -> np.ndarray:
    """Sorted hashes of the lines that are common in all documents; ``among`` (sorted hashes): of these lines only."""
    shared = None if among is None else documents.sparkSession.sparkContext.broadcast(among)
    per = documents.select(text_bytes(text)).mapInArrow(_surroundings(shared), "line long, around long, n long").groupBy("line", "around").agg(F.sum("n").alias("n"))
    found = per.groupBy("line").agg(F.count("*").alias("places"), F.sum("n").alias("n")).where((F.col("places") >= cfg.common_least) & (2 * F.col("places") >= F.col("n")))
    return np.sort(found.select("line").toArrow().column(0).to_numpy())


def _line_hashes(batches):
    for b in batches:
        for _, _, texts in slices(b.column(0)):
            found = {line_hash(x) for data in texts for x in data.split(b"\n") if x.strip()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["line"])


def is_common(lines: list[bytes], common: np.ndarray) -> np.ndarray:
    if not len(common) or not lines:
        return np.zeros(len(lines), bool)
    h = np.array([line_hash(x) for x in lines], np.int64)
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    out = np.zeros((len(lines), FEATURES))
    seen_lines: set[bytes] = set()
    seen_words: Counter = Counter()
    for i, (line, w) in enumerate(zip(lines, words, strict=True)):
        n, size = len(w), max(1, sum(map(len, w)))
        symbols = len(_SYMBOLS.findall(line)) / n
        bars = line.count(b"|") / n
        again = sum(1 for x in w if len(x) > 3 and seen_words[x] > 0) / n
        stops = len(_STOPS.findall(line)) / n
        out[i] = (
            1.0,
            min(n, 40) / 40,
            n < 4,
            min(symbols, 2.0),
            symbols > 0.2,
            min(bars, 1.0) * 2,
            len(_DIGITS.findall(line)) / size,
            len(_UPPER.findall(line)) / size * 5,
            min(size / n, 15) / 10,
            line.rstrip().endswith((b".", b"!", b"?", b'"', b":")),
            min(stops, 0.5) * 2,
            line in seen_lines,
            again,
            i == 0,
            len({*w}) / n,
            size / n > 9,
        )
        seen_lines.add(line)
        seen_words.update({*w})
    return out


def word_buckets(words: list[list[bytes]]) -> np.ndarray:
    """Bucket of every word (A-Z in lower case), line after line."""
    return np.fromiter((zlib.crc32(x.lower()) % BUCKETS for w in words for x in w), np.int32, sum(map(len, words)))


def mark_lines(lines: list[bytes], words: list[list[bytes]], crf: Crf) -> np.ndarray:
    """Labels (1: content) of a document's lines, each of which has a word."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    lexical = np.add.reduceat(crf.lexicon[word_buckets(words)], np.concatenate([[0], np.cumsum(counts)[:-1]])) / np.sqrt(counts)[:, None]
    return viterbi(line_features(lines, words) @ crf.weights + lexical, crf)


def viterbi(scores: np.ndarray, crf: Crf) -> np.ndarray:
    """Best labels (1: content) of a sequence of line scores; ties go to content."""
    n = len(scores)
    back = np.zeros((n, 2), np.int8)
    v = scores[0] + crf.start
    for i in range(1, n):
        a0, a1 = v[0] + crf.moves[0], v[1] + crf.moves[1]
        back[i] = a1 >= a0
        v = np.where(a1 >= a0, a1, a0) + scores[i]
    out = np.zeros(n, np.int8)
    out[-1] = v[1] >= v[0]
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def places(lengths: list[int]):
    """Order (longest first) of sequences, where their lines, one sequence after the other in that order, go if
    line t of all sequences that have one is [offsets[t]:offsets[t + 1]], sequence of each line, offsets."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    lengths = np.array([lengths[i] for i in order])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offsets = np.concatenate([[0], np.cumsum(active)])
    step = np.concatenate([np.arange(n) for n in lengths])
    row = np.repeat(np.arange(len(order)), lengths)
    return order, offsets[step] + row, row, offsets


def time_major(sequences: list[tuple[np.ndarray, np.ndarray]]):
    """Features, labels, sequence of each line and bounds by step, as ``places`` puts them."""
    order, at, row, offsets = places([len(y) for _, y in sequences])
    x, y, of = np.empty((len(row), FEATURES)), np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    x[at] = np.concatenate([sequences[i][0] for i in order])
    y[at] = np.concatenate([sequences[i][1] for i in order])
    of[at] = row
    return x, y, of, offsets


def gradient(x, y, of, offsets, weight, crf: Crf, words=None):
    """Gradient of the weighted log-likelihood: (weights, moves, start) and, with ``words`` (line, bucket and share
    of each word), lexicon. Forward-backward runs over all sequences at once, step by step."""
    s = x @ crf.weights
    if words is not None:
        line, bucket, share = words
        for k in range(2):
            s[:, k] += np.bincount(line, crf.lexicon[bucket, k] * share, len(s))
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    part = [slice(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    now = s[part[0]] + crf.start
    alpha[part[0]] = now
    z = add(now)
    for p in part[1:]:
        n = p.stop - p.start
        now = add((now[:n, :, None] + crf.moves).swapaxes(1, 2)) + s[p]
        alpha[p] = now
        z[:n] = add(now)
    moves = np.zeros((2, 2))
    for t in range(len(part) - 1, 0, -1):
        p = part[t]
        n = p.stop - p.start
        q = slice(part[t - 1].start, part[t - 1].start + n)
        ahead = s[p] + beta[p]
        pair = np.exp(alpha[q, :, None] + crf.moves + ahead[:, None, :] - z[:n, None, None])
        moves -= (pair * weight[:n, None, None]).sum(0)
        np.add.at(moves, (y[q], y[p]), weight[:n])
        beta[q] = add(crf.moves + ahead[:, None, :])
    rest = (np.eye(2)[y] - np.exp(alpha + beta - z[of, None])) * weight[of, None]
    out = x.T @ rest, moves, rest[part[0]].sum(0)
    if words is None:
        return out
    return *out, np.stack([np.bincount(bucket, rest[line, k] * share, BUCKETS) for k in range(2)], 1)


def _mixing_round(shared, cfg: CrfConfig):
    """Gradient steps over the sequences of one partition; gives, by position, the parameters times the
    documents, and the documents. Weights of words that the partition does not hold are left out."""

    def run(batches):
        crf, balance = shared.value
        sequences, quality, buckets, counts = [], [], [], []
        for b in batches:
            for x, y, q, w, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                sequences.append((np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(y, np.int8).astype(np.int64)))
                quality.append(q)
                buckets.append(np.frombuffer(w, np.int32))
                counts.append(np.frombuffer(n, np.int32))
        if not sequences:
            return
        order, at, _, _ = places([len(y) for _, y in sequences])
        batch = time_major(sequences)
        n = np.concatenate([counts[i] for i in order])
        words = np.repeat(at, n), np.concatenate([buckets[i] for i in order]), np.repeat(1 / np.sqrt(n), n)
        # a document counts once, whatever its length, and both kinds of document alike
        weight = np.array([balance[quality[i]] / len(sequences[i][1]) for i in order])
        params = [crf.weights.copy(), crf.moves.copy(), crf.start.copy(), crf.lexicon.copy()]
        here = np.unique(words[1]).astype(np.int64)  # only words of this partition move
        speed, seen = [np.zeros_like(a) for a in params[:3]], np.zeros((len(here), 2))
        for _ in range(cfg.steps):
            *dense, lexical = gradient(*batch, weight, Crf(*params), words)
            for a, g, v in zip(params, dense, speed, strict=False):
                v *= 0.9
                v += g / weight.sum() - cfg.l2 * a
                a += cfg.rate * v
            # words differ in frequency by orders of magnitude: steps go by the gradients seen so far
            g = lexical[here] / weight.sum() - cfg.word_l2 * params[3][here]
            seen += g * g
            params[3][here] += cfg.word_rate * g / (np.sqrt(seen) + 1e-9)
        at = np.concatenate([np.arange(DENSE), (DENSE + 2 * here[:, None] + [0, 1]).ravel()])
        flat = np.concatenate([a.ravel() for a in params])[at]
        # in fixed point, so that sums do not depend on their order
        docs = np.full(len(at), len(sequences), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(flat * docs * FIXED).astype(np.int64)), pa.array(docs)], names=["at", "total", "docs"])

    return run


def train(lines: DataFrame, cfg: CrfConfig = CrfConfig()) -> Crf:
    """lines: x (features, float32 bytes), y (labels, int8 bytes), quality, w (buckets of words, int32 bytes), n (words of lines, int32 bytes); a row per document that has a line. Without lines of both
    labels the field stays at zero, which marks every line content."""
    crf = Crf()
    marks = lines.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), F.max(F.expr("hex(y) like '%01%'")), F.max(F.expr("hex(y) like '%00%'"))).first()
    if not (marks[2] and marks[3]):
        return crf
    n = marks[0] + marks[1]
    balance = {1: 0.5 * n / max(1, marks[0]), 0: 0.5 * n / max(1, marks[1])}
    for _ in range(cfg.rounds):
        shared = lines.sparkSession.sparkContext.broadcast((crf, balance))
        each = lines.select("x", "y", "quality", "w", "n").mapInArrow(_mixing_round(shared, cfg), "at long, total long, docs long")
        got = each.groupBy("at").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).toArrow()
        at, total, docs = (got.column(i).to_numpy() for i in range(3))
        flat = np.concatenate([a.ravel() for a in (crf.weights, crf.moves, crf.start, crf.lexicon)])
        flat[at] = total / FIXED / docs
        k = FEATURES * 2
        crf = Crf(flat[:k].reshape(FEATURES, 2), flat[k : k + 4].reshape(2, 2), flat[k + 4 : DENSE], flat[DENSE:].reshape(BUCKETS, 2))
    return crf


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words that lie in a window of n words which the text holds twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    rank, count = w, len(words)
    for k in range(1, n):  # exact: pairs (rank of the k-word window, next word) are ranked anew
        key = rank[: count - k] * len(ids) + w[k:]
        rank = np.unique(key, return_inverse=True)[1]
    often = np.bincount(rank)[rank] > 1
    cover = np.zeros(count + 1, np.int64)
    np.add.at(cover, np.flatnonzero(often), 1)
    np.add.at(cover, np.flatnonzero(often) + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def examine(data: bytes, crf: Crf) -> tuple:
    lines = data.split(b"\n")
    split = [line.split() for line in lines]
    full = [(line, w) for line, w in zip(lines, split, strict=True) if w]
    words = [x for _, w in full for x in w]
    chars = sum(map(len, words)) if data.isascii() else len(_REST.sub(b"", data).decode("utf-8", "replace"))
    n, again = len(words), repeated_words(words)
    failed = n < 10 or 100 * again > 20 * n
    content, lines = 0, 0
    if full:
        marks = mark_lines([a for a, _ in full], [w for _, w in full], crf)
        content = sum(len(w) for (_, w), m in zip(full, marks, strict=True) if m)
        lines = int(marks.sum())
    share = content / n if n else 0.0
    return n, chars, len(_SYMBOLS.findall(data)), len(full) - len({a for a, _ in full}), again, failed, not failed and share >= crf.content_share, share, len(full), lines


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def _labelled_lines(shared):
    @F.pandas_udf("x binary, y binary, w binary, n binary")
    def run(text: pd.Series, quality: pd.Series) -> pd.DataFrame:
        common, out = shared.value, []
        for data, q in zip(text, quality, strict=True):
            lines = [(x, w) for x in data.split(b"\n") if (w := x.split())]
            every, words = [a for a, _ in lines], [w for _, w in lines]
            y = ~is_common(every, common) & (q > 0)
            out.append((line_features(every, words).astype(np.float32).tobytes(), y.astype(np.int8).tobytes(), word_buckets(words).tobytes(), np.array([len(w) for w in words], np.int32).tobytes()))
        return pd.DataFrame(out, columns=["x", "y", "w", "n"])

    return run


def best_share(shares: np.ndarray, quality: np.ndarray) -> float:
    """The content share that parts good from bad documents best (of equally good ones the middle)."""
    if len({*quality.tolist()}) < 2:
        return 0.5
    cuts = np.unique(np.concatenate([shares, [0.0, 1.0]]))
    cuts = np.concatenate([(cuts[:-1] + cuts[1:]) / 2])
    value = np.array([(shares[quality == 1] >= c).mean() - (shares[quality == 0] >= c).mean() for c in cuts])
    best = cuts[value >= value.max() - 1e-12]
    return float(best[len(best) // 2])


def fit(documents: DataFrame, labels: DataFrame, keep: Column, cfg: CrfConfig = CrfConfig(), label: str = "quality") -> Crf:
    """Learn from labelled documents for which ``keep`` (a condition on doc_id) holds; where their lines
    stand is counted over all documents. Null texts are empty; of equal texts one is taken."""
    spark = documents.sparkSession
    sample = materialize(labelled_sample(documents, labels, label, keep, cfg.max_docs, "crf"), "crf-sample")
    among = sample.select(text_bytes("text")).mapInArrow(_line_hashes, "line long").distinct().toArrow().column(0).to_numpy()
    shared = spark.sparkContext.broadcast(common_lines(documents, cfg, among=np.sort(among)))
    quality = (F.col("label") > 0).cast("int")
    lines = sample.select("doc_id", _labelled_lines(shared)(text_bytes("text"), quality).alias("l"), quality.alias("quality"), text_bytes("text").alias("text"))
    # dealt by hash in a fixed order, so that reruns mix the same parameters
    lines = lines.select("doc_id", "l.*", "quality", "text").where(F.length("x") > 0)
    lines = materialize(lines.repartition(cfg.parts, F.xxhash64("doc_id")).sortWithinPartitions("doc_id"), "crf-lines")
    deal = lines.drop("text").repartition(cfg.parts, F.xxhash64("doc_id")).sortWithinPartitions("doc_id")
    # the share is fitted on documents that the field which marks them has not learned from
    unseen = F.abs(F.xxhash64(F.lit("share"), "doc_id")) % 4 == 0
    first = train(deal.where(~unseen), cfg)
    got = lines.where(unseen).select("quality", line_quality(spark, first)["content_share"].alias("share")).toPandas()
    crf = train(deal, cfg)
    crf.content_share = best_share(got["share"].to_numpy(float), got["quality"].to_numpy(int))
    return crf


def line_quality(spark: SparkSession, crf: Crf, text: str = "text") -> Column:
    """The columns of RESULT for a text, as a struct; the model is broadcast."""
    shared = spark.sparkContext.broadcast(crf)

    @F.pandas_udf(RESULT)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([examine(x, shared.value) for x in data], columns=[c.split()[0] for c in RESULT.split(", ")])

    return run(text_bytes(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ids and rows included. Null, empty and wordless texts have
    no words and fail the base rules; very long texts are taken whole; without labels every line
    is content; an empty table gives an empty result; other columns are not read."""
    documents = table(spark, sf_dir, "documents")
    crf = fit(documents, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return documents.select("doc_id", line_quality(spark, crf).alias("q")).select("doc_id", "q.*")
