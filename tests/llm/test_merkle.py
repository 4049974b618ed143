"""The Merkle manifest against a plain loop and against SQL, ranks against sorting."""

import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from gridquill.llm import merkle, oracles, radix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(s):
    return sha256(s.encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    f = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return _h("".join(f))


def _tree(digests):
    """Levels of digests, lowest first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([_h("".join(x[i : i + 16])) for i in range(0, len(x), 16)])
    return levels


def _way(levels, at):
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run, at % 16
        at //= 16


def _manifest(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees[s] = _tree([_leaf(*r) for r in sources[s]])
    top = _tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(sources[s]):
            way = [*_way(trees[s], at), *_way(top, k)]
            proof = _h("".join("".join(run[:i] + run[i + 1 :]) for run, i in way))
            low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now = _leaf(*r) if r[0] is None or crc32(str(r[0]).encode()) % 5 else _leaf(r[0], low, *r[2:])
            for run, i in way:
                now = _h("".join(run[:i] + [now] + run[i + 1 :]))
            out.append((r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 300], [4100] + [1] * 20, [3] * 260], ids=lambda s: f"{len(s)}x{s[0]}")
def test_against_a_loop(spark, sizes):
    rng = random.Random(len(sizes))
    rows, ids = [], rng.sample(range(-(10**6), 10**12), sum(sizes))
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((ids.pop(), rng.choice([None, "", "Some Text É", "plain"]), rng.choice([None, "en"]), None if k == 1 else f"é{k}" if k % 3 else f"s{k}", rng.choice([None, 5])))
    rng.shuffle(rows)
    assert _rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == _manifest(rows)


def test_tampering_shows_where_capitals_are(spark, sf):
    got = merkle.query(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        touched = crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] == (not touched)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert _rows(merkle.query(spark, sf)) == sorted(con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({oracles.MERKLE})").fetchall(), key=repr)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _rows(merkle.manifest(odd)) == _manifest(rows)
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_ranks(spark, block):
    rng = random.Random(6)
    keys = [None] * 40 + [7] * 60 + [rng.randint(-(2**63), 2**63 - 1) for _ in range(200)] + list(range(500)) + [-1, 0, 2**63 - 1, -(2**63)]
    rows = [(i, rng.choice([None, "a", "b"]), k, rng.randint(0, 3)) for i, k in enumerate(keys)]
    got = radix.group_ranks(spark.createDataFrame(rows, "row long, g string, k long, tie long"), "g", ["k", "tie", "row"], block, 5).collect()
    assert len(got) == len(rows)
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[0]))
        assert [r["row"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [r[0] for r in mine]
        assert {(r["rank"]) for r in got if r["g"] == g} == set(range(len(mine))) and {r["n"] for r in got if r["g"] == g} == {len(mine)}


@pytest.mark.parametrize("k", [0, 1, 50, 77, 420, 804, 900])
def test_kth(spark, k):
    rng = random.Random(7)
    rows = [(i, rng.choice([5, -3, rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 2000)]), rng.choice([None, 1, 2**40])) for i in range(804)]
    df = spark.createDataFrame(rows, "row long, k long, id long")
    got = {r["row"] for r in df.where(radix.kth(df, ["k", "id", "row"], k, 7)).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[0]))[:k]
    assert got == {r[0] for r in want}
