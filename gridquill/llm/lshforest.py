"""MinHash near-dedup by an LSH forest.

Every document gets ``trees`` short MinHash signatures. For each tree all documents are brought
into the order of their signature (a global range sort: hot regions spread over tasks, since
ties are broken by the document), and documents next to each other with a long common prefix
are candidates. The depth adapts to the region: a run of documents that share the first
``depth`` hashes is one region; while a region holds more than ``region`` different documents it
is divided by the next hash. Within a region of that size all are each other's neighbours; where
the signature is used up and the region is still larger, each document takes its ``reach``
next ones in the order.

A divided region, and one at the edge of a task, does not pair all of its documents. These
documents are marked *hot*, and all pairs of hot documents are found by an exact prefix-filter join: the
shingles of a set are put in one global order, about the rarest first; two sets that are similar
enough share one among the first ninth of the smaller set and the first fifth of the larger, at
places that leave room for the overlap. Pairs inside a component of the first round are left out.

Candidates are confirmed on full shingle sets in rounds. In each of the first ``rounds`` every document is
held against its most promising candidate, later ``wide`` of them, outside its component; what that
links becomes one component, so that a large group of near copies grows together before its pairs are
listed. Of the remaining candidates, and of the hot pairs, only those between different
components need a look, and all of those get it.
Equal sets are found by a digest of the set and are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, lower_words, materialize, slices, table, text_bytes
from .components import connected_components


@dataclass(frozen=True)
class ForestConfig:
    shingle: int = 4  # words of a shingle
    percent: int = 80  # similarity of a link
    trees: int = 20
    depth: int = 3  # least common prefix of neighbours
    length: int = 8  # hashes of a tree's signature
    region: int = 16  # documents of a region that is not divided further
    reach: int = 4  # neighbours where the signature is used up
    rounds: int = 3  # of confirmation before the pairs that are left
    wide: int = 3  # candidates of a document in all of them but the first
    seed: int = 20240229


class _Hashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def shingle_hashes(data: bytes, k: int, cache: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (fewer words: of the whole text)."""
    words = lower_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(h) - n + 1, n * _ODD[-1] % 2**64, np.uint64)
    for i in range(n):
        x = h[i : len(h) - n + 1 + i] * np.uint64(_ODD[i % 6])
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(_ODD[(i + 1) % 6])
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signatures(sets: list[np.ndarray], cfg: ForestConfig) -> np.ndarray:
    """MinHashes, one row per (non-empty) set."""
    rng = np.random.default_rng(cfg.seed)
    count = cfg.trees * cfg.length
    a = rng.integers(1, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    for j in range(count):
        y = x * a[j] + b[j]
        y ^= y >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(y, starts)
    return out


def _sign(cfg: ForestConfig):
    def run(batches):
        cache = _Hashes()
        for batch in batches:
            ids = batch.column(0)
            for at, end, texts in slices(batch.column(1)):
                sets = [shingle_hashes(t, cfg.shingle, cache) for t in texts]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, cfg).astype(">u4")) if full else iter(())
                rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, next(sig).tobytes() if len(s) else None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    return run


def region_pairs(keys: list[bytes], depth: int, cfg: ForestConfig):
    """Index pairs of one sorted region whose keys share ``depth`` hashes."""
    if len(keys) < 2:
        return
    if len(keys) <= cfg.region:
        yield from ((i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)))
    elif depth >= cfg.length:
        yield from ((i, j) for i in range(len(keys)) for j in range(i + 1, min(i + 1 + cfg.reach, len(keys))))
    else:
        at, cut = 0, 4 * (depth + 1)
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i][:cut] != keys[at][:cut]:
                for x, y in region_pairs(keys[at:i], depth + 1, cfg):
                    yield at + x, at + y
                at = i


def _neighbours(cfg: ForestConfig):
    """Over rows sorted by (tree, key, digest, doc_id): pairs of ids, and (id, id) for the hot ones,
    those of a region that is divided or may go on in another task. Streams region by region; a
    region that outgrows ``hold`` is worked off in pieces that overlap by ``reach``."""
    hold, cut = 20_000, 4 * cfg.depth

    def flush(ids, keys, edge):
        pairs = list(region_pairs(keys, cfg.depth, cfg))
        if edge or len(ids) > cfg.region:
            pairs += [(i, i) for i in range(len(ids))]
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            a, b = [ids[i] for i, _ in part], [ids[j] for _, j in part]
            yield pa.RecordBatch.from_arrays([pa.array(map(min, a, b), pa.int64()), pa.array(map(max, a, b), pa.int64())], names=["a", "b"])

    def run(batches):
        head, digest, ids, keys, edge = None, None, [], [], True
        for batch in batches:
            for tree, key, d, doc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (tree, key[:cut]) != head:
                    yield from flush(ids, keys, edge)
                    edge = head is None
                    head, digest, ids, keys = (tree, key[:cut]), None, [], []
                if d != digest:  # of equal sets, which stand together, one is enough
                    ids.append(doc)
                    keys.append(key)
                    digest = d
                if len(ids) > hold:
                    yield from flush(ids, keys, True)
                    ids, keys, edge = ids[-cfg.reach :], keys[-cfg.reach :], True
        yield from flush(ids, keys, True)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(cfg: ForestConfig):
    def run(batches):
        cache = _Hashes()
        for batch in batches:
            for at, end, left in slices(batch.column(2)):
                right = batch.column(3).slice(at, end - at).to_pylist()
                keep = [similar(shingle_hashes(x, cfg.shingle, cache), shingle_hashes(y, cfg.shingle, cache), cfg.percent) for x, y in zip(left, right, strict=True)]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, end - at).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, cfg: ForestConfig) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Texts always move by a sort-merge
    join, so that the plan is the same at every size."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(cfg), "a long, b long")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _bucket_counts(cfg: ForestConfig):
    """Sets with a shingle, by bucket of the shingle's hash: at most 2**20 rows a partition."""

    def run(batches):
        cache, n = _Hashes(), np.zeros(2**20, np.int64)
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for t in texts:
                    np.add.at(n, _bucket(shingle_hashes(t, cfg.shingle, cache)), 1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen])], names=["bucket", "n"])

    return run


WIDE = 16  # longs of a parity bitmap


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of WIDE longs in which every shingle flips one bit: two bitmaps differ in no more
    bits than their sets do in shingles."""
    bit = ((hashes >> np.uint64(20)) % np.uint64(64 * WIDE)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(shared, cfg: ForestConfig):
    """Of each set the shingles one of which every similar set holds, in the global order, and its bitmap."""

    def run(batches):
        cache, counts = _Hashes(), shared.value
        for batch in batches:
            ids = batch.column(0)
            for at, end, texts in slices(batch.column(1)):
                sets = [shingle_hashes(t, cfg.shingle, cache) for t in texts]
                heads = [s[np.lexsort((s, counts[_bucket(s)]))][: len(s) - -(-cfg.percent * len(s) // 100) + 1].view(np.int64) for s in sets]
                maps = np.stack([parity(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(map(len, sets), pa.int64()), pa.array(heads, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(WIDE))],
                    names=["doc_id", "n", "tokens", *(f"m{i}" for i in range(WIDE))],
                )

    return run


def hot_pairs(texts: DataFrame, part: DataFrame, cfg: ForestConfig) -> DataFrame:
    """(a, b): all pairs of different components of ``part`` that may be similar enough. The
    order of the shingles is that of their counts by hash bucket, then of the hash: any order
    is right, one by rarity gives few candidates."""
    counts = np.zeros(2**20, np.int64)
    got = texts.select("text").mapInArrow(_bucket_counts(cfg), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    bits = [f"m{i}" for i in range(WIDE)]
    sets = texts.select("doc_id", "text").mapInArrow(_prefixes(shared, cfg), "doc_id long, n long, tokens array<long>, " + ", ".join(f"{b} long" for b in bits))
    sets = sets.join(part.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "tokens", F.coalesce("component", "doc_id").alias("c"), *bits)
    sets = materialize(sets, "forest-prefixes")
    posts = sets.select("doc_id", "n", "c", F.posexplode("tokens").alias("i", "token"), *bits)
    # inside the component that holds most of a shingle's sets no pair is looked at
    main = posts.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("m", "c")).alias("main"))
    main = main.where("k > 1").select("token", F.col("main.c").alias("main"))
    posts = materialize(posts.join(main.hint("merge"), "token").withColumn("minor", F.col("c") != F.col("main")).drop("main"), "forest-postings")
    p = cfg.percent
    side = lambda s: [F.col(c).alias(f"{c}{s}") for c in ("doc_id", "n", "c", "i", "minor", *bits)]
    # the smaller set of a pair has more than its size less the least overlap of two of its size before it
    small = posts.where(f"i <= n - (2 * {p} * n + {99 + p}) div {100 + p}").select("token", *side("x"))
    large = posts.select("token", *side("y"))
    differ = " + ".join(f"bit_count({b}x ^ {b}y)" for b in bits)
    fits = f"cx <> cy and (nx < ny or nx = ny and doc_idx < doc_idy) and {100 + p} * least(nx - ix, ny - iy) >= {p} * (nx + ny) and {100 + p} * ({differ}) <= {100 - p} * (nx + ny)"
    both = small.where("minorx").join(large.hint("merge"), "token").where(fits)
    both = both.unionByName(small.where("not minorx").join(large.where("minory").hint("merge"), "token").where(fits))
    return both.select(F.least("doc_idx", "doc_idy").alias("a"), F.greatest("doc_idx", "doc_idy").alias("b")).distinct()


def _of(part: DataFrame, end: str) -> DataFrame:
    return part.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    both = pairs.join(_of(part, "a"), "a", "left").join(_of(part, "b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _merged(part: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the components at the ends of each link have become one."""
    between = links.join(_of(part, "a"), "a", "left").join(_of(part, "b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = materialize(connected_components(between, "a", "b"), "forest-parts")
    joined = part.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    known = joined.select("node", F.coalesce("top", "component").alias("component"))
    return materialize(known.unionByName(top.join(part.select("node"), "node", "left_anti")), "forest-parts")


def row_components(source: DataFrame, cfg: ForestConfig) -> DataFrame:
    """doc_id, n_shingles, component_id for rows (doc_id long, each once; text bytes)."""
    signed = materialize(source.mapInArrow(_sign(cfg), "doc_id long, n_shingles long, digest binary, signature binary"), "forest-signatures")
    size = 4 * cfg.length
    rows = signed.where("digest is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree"), "signature", "digest", "doc_id"
    ).select("tree", F.expr(f"substring(signature, 1 + {size} * tree, {size})").alias("key"), "digest", "doc_id")
    ordered = rows.repartitionByRange("tree", "key", "digest", "doc_id").sortWithinPartitions("tree", "key", "digest", "doc_id")
    pairs = ordered.mapInArrow(_neighbours(cfg), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("support"))
    pairs = materialize(pairs, "forest-candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), (F.col("a") == F.col("b")).alias("hot")).groupBy("doc_id").agg(F.max("hot").alias("hot"))
    pairs = pairs.where("a <> b")
    texts = materialize(source.join(wanted.hint("merge"), "doc_id"), "forest-texts")
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # written first, so that the join below has exchanges of its own, which skew handling can split
    copies = materialize(copies, "forest-digests")
    copies = materialize(signed.select("doc_id", "digest").join(copies, "digest").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "forest-copies")

    part = materialize(connected_components(copies, "a", "b"), "forest-parts")
    left = pairs
    for r in range(cfg.rounds):
        left = materialize(_apart(left, part), "forest-left")
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("support"), "a"))
        left = left.withColumn("rank", rank)
        limit = 1 if r == 0 else cfg.wide
        linked = materialize(confirm(left.where(F.col("rank") <= limit), texts, cfg), "forest-links")
        part = _merged(part, linked)
        left = left.where(F.col("rank") > limit).drop("rank")
    left = _apart(left, part)
    hot = hot_pairs(texts.where("hot"), part, cfg)
    more = materialize(confirm(left.select("a", "b").unionByName(hot).distinct(), texts, cfg), "forest-links")
    discard(texts)
    final = _merged(part, more)
    out = signed.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _numbered(docs: DataFrame, columns: list) -> DataFrame:
    return materialize(docs.select(F.monotonically_increasing_id().alias("__gq_row"), *columns), "forest-rows")


def _grouped(base: DataFrame, cfg: ForestConfig, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_shingles, component_id (least id of the component, null if it has none), first:
    whether the row is the one of its component that stays (least id, then least row)."""
    rows = row_components(base.select(F.col("__gq_row").alias("doc_id"), text_bytes(f"`{text_col}`").alias("text")), cfg)
    rows = rows.withColumnsRenamed({"doc_id": "row", "component_id": "component"})
    rows = rows.join(base.select(F.col("__gq_row").alias("row"), F.col(f"`{id_col}`").alias("doc_id")), "row")
    rows = materialize(rows, "forest-groups")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = materialize(best.select("component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row")), "forest-best")
    return rows.join(best, "component").select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("best_row")).alias("first"))


def near_duplicates(docs: DataFrame, cfg: ForestConfig = ForestConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; ids may be of any type that has an order.

    Rows are told apart by a number, so null and repeated ids are grouped by their texts like all others.
    component_id is the least id of the component (null if it has null ids only), kept whether the id is
    that one. Null and word-less texts have no shingles and link with nothing; fewer than ``shingle``
    words make one shingle; very long texts are taken whole. An empty table gives an empty result;
    other columns are not read.
    """
    base = _numbered(docs, [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")])
    return _grouped(base, cfg, "doc_id", "text").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one of least id, on five-word shingles.

    Of repeated rows and ids with similar texts one row stays; rows with null ids are grouped like others and
    come last in a group; null and wordless texts link with nothing and stay. All columns of
    ``docs`` are kept; an empty table stays empty."""
    base = _numbered(docs, [F.col(f"`{c}`") for c in docs.columns])
    kept = _grouped(base, ForestConfig(shingle=5), "doc_id", "text").where("first").select(F.col("row").alias("__gq_row"))
    return base.join(kept, "__gq_row", "left_semi").drop("__gq_row")
