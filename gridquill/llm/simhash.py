"""SimHash near-dedup by anchor points of a covering code.

The 64 bits are cut into three segments; of two fingerprints that differ in at most four bits, one segment
differs in at most as many bits as its share of the threshold (1, 1 and 0: more in every segment would be five). The
anchors of a segment are the words of a linear code, a Hamming code on 15 of its bits and all values of the
others, with covering radius 1: every value has its nearest anchor, its *home*, within one bit. A
fingerprint is replicated to every anchor within covering radius plus threshold, about 31 in all; there it meets each
fingerprint whose home the anchor is and that may be a neighbour, and the full 64 bits are compared.
One code over all 64 bits with as many anchors would need some thousand replicas for a threshold of four.

Within an anchor the comparison walks the links: from a fingerprint to those not yet reached, so that a
dense group costs about its size and yields a tree of links instead of all pairs. An anchor with more than
``bucket`` fingerprints is divided by the anchors of the same code on the rotated bits, again for the full threshold, so
no task gets an unbounded group. Only different fingerprints are compared; documents meet theirs again in a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_words, materialize, slices, table, text_bytes
from .components import connected_components


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 4  # words of a shingle
    seed: int = 42  # of XXH64
    distance: int = 4  # differing bits of a link; the shares of SEGMENTS belong to it
    bucket: int = 100_000  # fingerprints of an anchor that is not divided further
    rotations: tuple[int, ...] = (0, 11, 37)  # of the bits, from one division to the next


#: (first bit, bits, share of the threshold); shares plus one add up to five.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
RADIUS, CODED = 1, 15


def fingerprint(data: bytes, cfg: SimHashConfig = SimHashConfig()) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    w = lower_words(data)
    if not w:
        return 0
    n = min(cfg.shingle, len(w))
    text = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    first, last = starts[: len(w) - n + 1].tolist(), ends[n - 1 :].tolist()
    for at in range(0, len(first), 1 << 15):  # a long text in stretches
        h = np.array([digest(text[a:b], cfg.seed) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    over = 2 * count > len(first)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _prints(cfg: SimHashConfig):
    def run(batches):
        for batch in batches:
            for at, end, texts in slices(batch.column(1)):
                got = np.array([fingerprint(t, cfg) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(got)], names=["doc_id", "print"])

    return run


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code on the low bits: the sum of the (one-based) places of the bits set."""
    out = np.zeros(len(x), np.int64)
    for i in range(CODED):
        out ^= (x.astype(np.int64) >> i & 1) * (i + 1)
    return out


@cache
def _moves(bits: int, within: int) -> list[np.ndarray]:
    """By syndrome of a value: all changes of at most ``within`` bits that lead from it to an anchor."""
    single = np.array([1 << i for i in range(bits)], np.int64)
    found = [np.zeros(1, np.int64)]
    for _ in range(within):
        found.append(np.unique(np.concatenate([found[-1], (found[-1][:, None] | single).ravel()])))
    every = found[-1]
    place = _syndrome(every)
    return [every[place == s] for s in range(CODED + 1)]


def anchors(value: np.ndarray, bits: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``value``, anchor) for every anchor within ``within`` bits."""
    s, at, out = _syndrome(value), [], []
    for k, moves in enumerate(_moves(bits, within)):
        rows = np.flatnonzero(s == k)
        at.append(np.repeat(rows, len(moves)))
        out.append((value[rows][:, None] ^ moves).ravel())
    return np.concatenate(at), np.concatenate(out)


def _mixed(parent: np.ndarray, segment: int, anchor: np.ndarray) -> np.ndarray:
    """Key of an anchor below its parent's key. Two anchors with one key would only be compared with each other."""
    x = (parent.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (anchor.astype(np.uint64) << np.uint64(2) | np.uint64(segment))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def replicas(prints: np.ndarray, parent: np.ndarray, home: np.ndarray, rotation: int) -> tuple[np.ndarray, ...]:
    """(key, print, home): each fingerprint at all anchors within covering radius plus share."""
    u = prints.view(np.uint64)
    turned = u if not rotation else (u << np.uint64(rotation)) | (u >> np.uint64(64 - rotation))
    keys, rows, homes = [], [], []
    for k, (first, bits, share) in enumerate(SEGMENTS):
        value = ((turned >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        at, anchor = anchors(value, bits, RADIUS + share)
        keys.append(_mixed(parent[at], k, anchor))
        rows.append(at)
        # home: the anchor that differs in coded bits only, in one at most
        differ = value[at] ^ anchor
        homes.append(home[at] & ((differ >> CODED) == 0) & (np.bitwise_count(differ) <= RADIUS))
    rows = np.concatenate(rows)
    return np.concatenate(keys), prints[rows], np.concatenate(homes)


def _replicated(rotation: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                prints, parent, home = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                key, p, h = replicas(prints, parent, home, rotation)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p), pa.array(h)], names=["key", "print", "home"])

    return run


def walk(prints: np.ndarray, home: np.ndarray, distance: int):
    """Links (i, j) that connect what is connected, between fingerprints of one anchor of which one
    has its home there. Every fingerprint is held against those not reached before only."""
    order = np.argsort(~home, kind="stable")  # homes first
    p, homes = prints.view(np.uint64)[order], int(home.sum())
    left = np.arange(len(p))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            seen = left if i < homes else left[: np.searchsorted(left, homes)]
            near = np.bitwise_count(p[seen] ^ p[i]) <= distance
            if near.any():
                found = seen[near]
                yield from ((order[i], order[j]) for j in found.tolist())
                todo += found.tolist()
                left = np.concatenate([seen[~near], left[len(seen) :]])
        if not len(left) or left[0] >= homes:
            break


def _compared(cfg: SimHashConfig):
    """Over rows (key, print, home) sorted by key: links. Small anchors are compared many at a time, row with
    row a few places on; others are gathered, one at a time, and walked."""
    small = 32

    def pairs(key, p, home):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        many = np.repeat(sizes, sizes) > small
        a, b, u = [], [], p.view(np.uint64)
        for d in range(1, min(small, int(sizes.max()))):
            hit = (key[d:] == key[:-d]) & ~many[d:] & (home[d:] | home[:-d])
            at = np.flatnonzero(hit)
            at = at[np.bitwise_count(u[at] ^ u[at + d]) <= cfg.distance]
            a.append(p[at])
            b.append(p[at + d])
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            got = np.array(list(walk(p[s : s + n], home[s : s + n], cfg.distance)), np.int64).reshape(-1, 2) + s
            a.append(p[got[:, 0]])
            b.append(p[got[:, 1]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches):
        held = []  # the rows of the last key seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key = cols[0]
            cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if cut or (held and held[-1][0][-1] != key[0]):
                head = [np.concatenate([*(h[i] for h in held), cols[i][:cut]]) for i in range(3)]
                if len(head[0]):
                    yield from pairs(*head)
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield from pairs(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return run


def links(prints: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(a, b): links between the different fingerprints of ``prints`` (print long, each once) that connect all
    that is connected at ``cfg.distance`` bits."""
    rows, out = prints.select("print", F.lit(0).cast("long").alias("key"), F.lit(True).alias("home")), None
    for depth, rotation in enumerate(cfg.rotations):
        rows = materialize(rows.mapInArrow(_replicated(rotation), "key long, print long, home boolean"), "simhash-anchors")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any"))
        full = materialize(sizes.where(F.col("any") & (F.col("n") > cfg.bucket)).select("key"), "simhash-full")
        last = depth + 1 == len(cfg.rotations) or full.isEmpty()
        fit = rows if last else rows.join(full, "key", "left_anti")
        found = fit.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(cfg), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        rows = rows.join(full, "key", "left_semi").select("print", "key", "home")


def near_duplicates(docs: DataFrame, cfg: SimHashConfig = SimHashConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    Null and wordless texts have fingerprint zero, which links like any other; fewer words than a shingle make one
    shingle. component_id is the least id reachable (null if there are null ids only); repeated rows and ids keep their
    rows. Texts are read whole; an empty table gives an empty result; other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    marked = materialize(rows.mapInArrow(_prints(cfg), f"doc_id {kind}, print long"), "simhash-prints")
    least = materialize(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    part = connected_components(links(least.select("print"), cfg), "a", "b").select(F.col("node").alias("print"), "component")
    placed = materialize(least.join(part, "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")), "simhash-parts")
    # written first: each join below then has exchanges of its own, which skew handling can split
    ids = materialize(placed.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-components")
    ids = materialize(placed.join(ids, "component").select("print", "component_id"), "simhash-ids")
    return marked.join(ids, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
