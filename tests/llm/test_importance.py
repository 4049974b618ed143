"""Importance resampling against plain counting and SQL."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from gridquill.llm import importance, oracles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _resampled(docs, target):
    f = [(i, *_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, x in f:
        s.update(x)
    for x in target:
        t.update(_features(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000))))
    out = []
    for i, n, x in f:
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, x))
        out.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_checksums_of_runs():
    rng = random.Random(1)
    sums = importance.Checksums()
    for n in [0, 1, 2, 3, 50, 200]:
        text = " ".join("".join(rng.choices("abZé0 -_", k=rng.randint(1, 30))) for _ in range(n))
        assert sorted(sums.runs(importance.words(text.encode())) % 10000) == sorted(_features(text)[1])
    text = "a" * 70 + " b c " + "d" * 1000 + " e"
    assert sorted(sums.runs(importance.words(text.encode())) % 10000) == sorted(_features(text)[1])


def test_long_texts_in_stretches():
    text = " ".join(random.Random(2).choices(["x", "yy", "zzz", "w" * 80], weights=[5, 5, 5, 0.001], k=130_001))
    parts, n = importance.text_buckets(importance.Checksums(), text.encode(), 10000)
    want = _features(text)
    assert n == want[0] and Counter(b for p in parts for b in p.tolist()) == Counter(want[1])


@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_loop(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = _resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert _rows(importance.resample(docs.repartition(parts), target)) == want


def test_ties_and_repeated_rows(spark):
    text = "the same words " * 10
    docs = [(i % 50, text) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = _rows(importance.resample(df, spark.createDataFrame([("the same",)], "text string")))
    want = _resampled(docs, ["the same"])
    assert got == want and sum(r[4] is not None for r in got) == 20


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({oracles.RESAMPLE})").fetchall()
    assert _rows(importance.query(spark, sf)) == sorted(got, key=repr)


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(None,), ("",), ("same text here",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _rows(importance.resample(odd, target)) == _resampled(docs, [None, "", "same text here"])
    assert _rows(importance.resample(odd, target.where("false"))) == _resampled(docs, [])
    assert importance.resample(none, target).count() == 0
