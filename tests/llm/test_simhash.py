"""SimHash by anchor points: fingerprints by definition, covering by enumeration, components by all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridquill.llm import simhash
from gridquill.llm.common import table


def _fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, prints, distance=4):
    """Smallest id reachable, by all pairs."""
    p = np.array(prints, np.uint64)
    comp = dict.fromkeys(range(len(p)))
    for i in range(len(p)):
        if comp[i] is None:
            todo, comp[i] = [i], i
            while todo:
                near = np.flatnonzero(np.bitwise_count(p ^ p[todo.pop()]) <= distance)
                for j in near.tolist():
                    if comp[j] is None:
                        comp[j] = i
                        todo.append(j)
    least = {}
    for k, i in enumerate(ids):
        least[comp[k]] = min(i, least.get(comp[k], i))
    return {i: least[comp[k]] for k, i in enumerate(ids)}


def _flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def _linked(spark, prints, cfg):
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    got = simhash.links(df, cfg).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert (a ^ b).bit_count() <= 4 if a ^ b >= 0 else ((a ^ b) + 2**64).bit_count() <= 4
        root[find(a)] = find(b)
    groups = {}
    for x in signed:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values())), len(got)


def _expected(prints):
    comp = _components(range(len(prints)), prints)
    groups = {}
    for k, x in enumerate(prints):
        groups.setdefault(comp[k], set()).add(int(np.uint64(x).view(np.int64)))
    return sorted(map(sorted, groups.values()))


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", " \n", "One", "A b C", "a b c d", "x " * 70_000, *(" ".join(rng.choices(["Ab", "é", "ÉX", "q r", "zz"], k=n)) for n in range(1, 60))]:
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def test_covering():
    rng = np.random.default_rng(2)
    for first, bits, share in simhash.SEGMENTS:
        value = rng.integers(0, 1 << bits, 300)
        at, anchor = simhash.anchors(value, bits, simhash.RADIUS)
        assert set(at.tolist()) == set(range(300))  # an anchor within the radius of everything
        wide_at, wide = simhash.anchors(value, bits, simhash.RADIUS + share)
        # exactly the anchors in reach: all changes of so many bits, tried one by one
        for i in range(20):
            near = {int(value[i])}
            for _ in range(simhash.RADIUS + share):
                near |= {x ^ 1 << b for x in near for b in range(bits)}
            words = {x for x in near if not simhash._syndrome(np.array([x]))[0]}
            assert words == set(wide[wide_at == i].tolist())
    assert sum(s + 1 for *_, s in simhash.SEGMENTS) == 5 and sum(b for _, b, _ in simhash.SEGMENTS) == 64


@pytest.mark.parametrize("rotation", [0, 11, 37])
def test_every_pair_meets_at_a_home(rotation):
    rng = random.Random(3)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = _flipped(rng, x, rng.randint(0, 4))
        p = np.array([x, y], np.uint64).view(np.int64)
        key, pr, home = simhash.replicas(p, np.zeros(2, np.int64), np.ones(2, bool), rotation)
        assert {*key[(pr == p[0]) & home].tolist()} & {*key[pr == p[1]].tolist()}
        assert len(key) <= 2 * 70


@pytest.mark.parametrize("bucket", [100_000, 6])
def test_links_against_all_pairs(spark, bucket):
    rng = random.Random(4)
    prints = {0}
    for _ in range(60):  # families around the threshold, chains, and one dense ball
        x = rng.getrandbits(64)
        prints |= {x} | {_flipped(rng, x, rng.randint(1, 9)) for _ in range(rng.randint(0, 8))}
    x = rng.getrandbits(64)
    prints |= {_flipped(rng, x, rng.randint(0, 4)) for _ in range(400)}
    for _ in range(40):
        x = _flipped(rng, x, 4)
        prints.add(x)
    prints = sorted(prints)
    got, n = _linked(spark, prints, simhash.SimHashConfig(bucket=bucket))
    assert got == _expected(prints)


def test_a_dense_group_costs_about_its_size():
    rng = random.Random(5)
    x = rng.getrandbits(64)
    p = np.unique(np.array([_flipped(rng, x, 2) for _ in range(1500)] + [x], np.uint64)).view(np.int64)
    got = list(simhash.walk(p, np.ones(len(p), bool), 4))
    assert len(got) == len(p) - 1  # a tree


def test_documents_against_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    some = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    some += [(10**6 + i, t.upper()) for i, t in some[:20]] + [(10**7 + i, t + " more") for i, t in some[::7]]
    df = spark.createDataFrame(some, "doc_id long, text string")
    prints = [_fingerprint(t) for _, t in some]
    want = _components([i for i, _ in some], prints)
    for parts in (1, 9):
        got = simhash.near_duplicates(df.repartition(parts)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for (i, _), p in zip(some, prints, strict=True)}


def test_odd_rows(spark, odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = {i: (f, c) for i, f, c in got if i is not None}
    assert by_id[1] == by_id[2] == by_id[8] == ("0" * 16, 1)
    assert by_id[4][1] == by_id[5][1] == 4 and sum(i is None and c == 4 for i, _, c in got) == 1
    assert simhash.near_duplicates(none).count() == 0
    named = simhash.near_duplicates(odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.where("doc_id = 'd5'").first()["component_id"] == "d4"
