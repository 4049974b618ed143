"""Every operator and stage on odd rows, with and without labels, and on an empty table: nothing
crashes, every row gets its result."""

import pytest
from pyspark.sql import functions as F

from gridquill.llm import bytecnn, decontam, hmm, importance, linecrf, lshforest, merkle, mixing, pii, secret_scan, simhash, token_cache, toxicity
from gridquill.llm.common import scratch_path


def _benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "zz qq"), (4, "same text here that is long enough to be a shingle or two")], "item_id long, text string")


def _toxicity(spark, docs, labels):
    return docs.select("doc_id", toxicity.score_column(spark, toxicity.fit(docs, labels, F.lit(True))).alias("r"))


def _hmm(spark, docs, labels):
    return hmm.score_texts(docs, F.col("doc_id") % 2 == 0, hmm.HmmConfig(rounds=2, symbols=64))


def _tokens(spark, docs, labels):
    import public_tokenizers

    return token_cache.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "cache"))


def _cnn(spark, docs, labels):
    return docs.select("doc_id", bytecnn.score_column(spark, bytecnn.fit(docs, labels, F.lit(True))).alias("r"))


def _mix(spark, docs, labels):
    return mixing.taken(mixing.mix(docs))


def _secrets(spark, docs, labels):
    scanned = secret_scan.scan(docs)
    return scanned.join(secret_scan.live_spans(scanned), "row_id", "left")


def _pii(spark, docs, labels):
    scanned = pii.scan(docs)
    return scanned.join(pii.discovered(scanned), "row_id", "left")


def _decontam(spark, docs, labels):
    return decontam.with_leaks(docs, _benchmark(spark))


def _crf(spark, docs, labels):
    return docs.select("doc_id", linecrf.line_quality(spark, linecrf.fit(docs, labels, F.lit(True))).alias("r"))


def _near(spark, docs, labels):
    return lshforest.near_duplicates(docs)


def _simhash(spark, docs, labels):
    return simhash.near_duplicates(docs)


def _merkle(spark, docs, labels):
    return merkle.manifest(docs)


def _resample(spark, docs, labels):
    return importance.resample(docs, _benchmark(spark))


RUNS = [_toxicity, _hmm, _tokens, _cnn, _mix, _secrets, _pii, _decontam, _crf, _near, _simhash, _merkle, _resample]
IDS = [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, None, None]
key = lambda i: (i is None, i)


@pytest.mark.parametrize("run", RUNS, ids=lambda f: f.__name__)
@pytest.mark.parametrize("labelled", [False, True], ids=["unlabelled", "labelled"])
def test_one_result_per_row(spark, odd, no_labels, run, labelled):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 11)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int") if labelled else no_labels
    got = run(spark, odd, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=key) == IDS


@pytest.mark.parametrize("run", RUNS, ids=lambda f: f.__name__)
def test_empty_table(spark, none, no_labels, run):
    assert run(spark, none, no_labels).count() == 0


STAGES = [toxicity.stage, lshforest.stage, decontam.stage, secret_scan.stage, mixing.stage]


@pytest.fixture(scope="module")
def side_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    _benchmark(spark).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__module__.rsplit(".", 1)[1])
def test_stages(spark, odd, none, side_tables, stage):
    assert stage(spark, none, side_tables).count() == 0
    got = stage(spark, odd, side_tables)
    ids = sorted((r["doc_id"] for r in got.collect()), key=key)
    if stage is mixing.stage:
        assert {*odd.columns} <= {*got.columns} and {1, 2, 8}.isdisjoint(ids) and {None, 5, 6} <= {*ids}
        each = got.where("doc_id = 5").agg(F.sum("words"), F.max("taken")).first()
        assert each[0] <= 2 * 2 * 13 and each[1] <= 2 * 13  # either of the repeated rows, twice at most
        return
    assert got.columns == odd.columns
    drops = {lshforest.stage: [5, 5, None], decontam.stage: [4, 5, 5, None]}.get(stage, [])
    want = list(IDS)
    for i in drops:
        want.remove(i)
    assert ids == want


def test_near_duplicates(spark, odd):
    got = {r["doc_id"]: r for r in lshforest.near_duplicates(odd).collect()}
    assert {i: got[i]["component_id"] for i in range(1, 11)} == {i: 4 if i == 5 else i for i in range(1, 11)}
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4, 6, 8)] == [0, 0, 1, 10, 1, 0]
    words = lshforest.near_duplicates(odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).where("doc_id = 'd5'").first()
    assert words["component_id"] == "d4" and not words["kept"]


def test_odd_spans(spark, odd):
    got = {r["doc_id"]: r["base"] for r in secret_scan.scan(odd).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[9]] == [("assign", 2, 23)]
    assert [s["kind"] for s in got[10]] == ["hex"] and got[1] == []
    got = {r["doc_id"]: r["base"] for r in pii.scan(odd).collect()}
    assert sorted((s["kind"], s["start"]) for s in got[9]) == [("email", 33), ("ip", 25), ("phone", 40)]
    assert got[10] == []


def test_secrets_of_null_ids_are_masked(spark, odd, side_tables):
    got = secret_scan.stage(spark, odd, side_tables).where("doc_id is null and text like '%token%'").collect()
    assert ["abcdef" in r["text"] for r in got] == [False]


def test_private_use_characters_are_no_seeds(spark):
    def found(mark):
        texts = [f"please write to user{i}@example.org for help" for i in range(12)] + [f"please write to zo{mark}rk{i} for help" for i in range(3)] + [f"please write to bob[at]x{i}.org for help" for i in range(3)]
        scanned = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        out = scanned.join(pii.discovered(scanned), "row_id").select("doc_id", F.explode("extra").alias("x")).select("doc_id", "x.start", "x.end")
        patterns, _ = pii.scores(*pii.graph(scanned))
        return sorted(map(tuple, out.collect())), sorted(round(r["score"], 9) for r in patterns.collect())

    plain, marked = found("x"), found("\ue041")
    assert plain == marked and [d for d, *_ in plain[0]] == list(range(12, 18))


def test_private_use_characters_in_sql(spark, tmp_path):
    import duckdb

    from gridquill.llm import oracles

    texts = [f"please write to user{i}@example.org for help" for i in range(12)] + ["please write to z\ue041rk for help", "\ue041 user@example.org \ue07e", "\ue020\ue100"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = pii.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracles.PII})").fetchall())


def test_decontam_with_named_items(spark):
    items = spark.createDataFrame([("b-2", "say zz qq now"), ("10", "one two three four"), ("9", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x say zz qq now one two three four"), (2, "clean")], "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontam.with_leaks(docs, items).collect()} == {1: "b-2,9,10", 2: ""}


def test_decontam_finds_the_copies(spark, odd):
    got = decontam.with_leaks(odd, _benchmark(spark)).where("item_ids <> ''").collect()
    assert sorted(((r["doc_id"], r["item_ids"]) for r in got), key=lambda x: key(x[0])) == [(4, "4"), (5, "4"), (5, "4"), (None, "4")]
    assert {r["item_ids"] for r in decontam.with_leaks(odd, _benchmark(spark).where("false")).collect()} == {""}
    # in blocks of one item the same, and short items are found as they are
    both = spark.createDataFrame([(7, "say zz qq now"), (8, "zz and qq"), (9, "same text here that is long enough to be a shingle or two zz qq")], "doc_id long, text string")
    for block in (1, 100):
        got = decontam.with_leaks(both, _benchmark(spark), cfg=decontam.DecontamConfig(block=block)).collect()
        assert {r["doc_id"]: r["item_ids"] for r in got} == {7: "3", 8: "", 9: "3,4"}
