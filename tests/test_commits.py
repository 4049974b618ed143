"""Commits of several writers, batches that come again, progress as a stream, bounded enrichment."""

import datetime as dt
import json
import random
import threading
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_sources_streaming import workbook

from gridquill.engine import Change, KnowledgeBase
from gridquill.operators import enrich, grams, search
from gridquill.streaming import progress


def _files(spark, *names):
    return spark.createDataFrame([(f"/in/{n}.xlsx", bytearray(workbook())) for n in names], "path string, content binary")


def _racing(kb, other, times=1):
    """Let ``other`` commit just before ``kb`` publishes its next change, as a second writer would."""
    publish, left = kb._publish, [times]

    def late(number, state):
        if left[0]:
            left[0] -= 1
            other()
        return publish(number, state)

    kb._publish = late


@pytest.fixture
def pair(spark, tmp_path):
    a, b = KnowledgeBase(spark, str(tmp_path / "kb")), KnowledgeBase(spark, str(tmp_path / "kb"))
    return a, b, [a.create_folder(n) for n in ("one", "two", "three")]


def _with_chunks(spark, kb, folder):
    """A chunk for every document (the workbook has a cover only), with what hangs on it."""
    sheet = kb.table("sheet").select(F.col("id").alias("sheet_id"), "document_id")
    chunk = sheet.select(F.col("document_id").alias("id"), "sheet_id", "document_id", F.lit(folder).alias("folder_id"), F.lit("some text ABC_12").alias("text"))
    kb.append(chunk=chunk, chunk_vec=chunk.select(F.col("id").alias("chunk_id"), kb.embed(F.col("text")).alias("embedding")), postings=search.postings(chunk, "id", "text"), grams=grams.gram_postings(chunk))


def names(kb):
    return sorted(r["name"] for r in kb.table("folder").collect())


def test_two_deletes(pair):
    a, b, (one, two, _) = pair
    _racing(a, lambda: b.delete_folder(two))
    a.delete_folder(one)
    assert names(a) == names(b) == ["three"]


def test_a_delete_and_an_update(pair):
    a, b, (one, two, _) = pair
    _racing(a, lambda: b.update_folder(two, name="new"))
    a.delete_folder(one)
    _racing(b, lambda: a.delete_folder(two))
    b.update_folder(two, name="again")  # it is gone by the time this is published
    assert names(a) == ["three"]


def test_ids_of_two_writers(pair):
    a, b, ids = pair
    got = []
    _racing(a, lambda: got.append(b.create_folder("x")))
    got.append(a.create_folder("y"))
    assert sorted(got) == [4, 5] and rows(a.table("folder"), "id") == [(i,) for i in range(1, 6)]


def test_an_upload_and_a_delete(spark, pair):
    a, b, (one, two, _) = pair
    a.upload(_files(spark, "kept"), two)
    _with_chunks(spark, a, two)
    _racing(a, lambda: b.upload(_files(spark, "a"), one))
    a.delete_folder(one)  # takes the document that came in between along
    assert names(a) == ["three", "two"] and [r["filename"] for r in a.list_documents().collect()] == ["kept.xlsx"]
    before = {t: a.table(t).count() for t in ("chunk", "postings", "grams", "chunk_vec", "sheet")}
    assert min(before.values()) > 0 and a.table("chunk").select("document_id").distinct().count() == 1
    _racing(a, lambda: b.delete_folder(two))
    with pytest.raises(ValueError):
        a.upload(_files(spark, "late"), two)
    assert a.table("document").count() == a.table("chunk").count() == a.table("postings").count() == 0


def test_an_upload_is_one_commit_and_a_batch_counts_once(spark, pair, monkeypatch):
    from gridquill.sources import xlsx

    a, b, (one, *_) = pair
    parses = []
    real = xlsx.stored
    monkeypatch.setattr(xlsx, "stored", lambda df, name: parses.append(name) or real(df, name))
    for df in xlsx.from_files(_files(spark, "a")).values():  # all four come from what the parser wrote
        assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert parses == ["workbooks"]
    at = a._current()[0]
    assert a.upload(_files(spark, "a"), one, stream=("landing", 0))
    assert a._current()[0] == at + 1 and parses == 2 * ["workbooks"]
    before = {t: rows(a.table(t), "id") for t in ("document", "sheet", "image")}
    assert before["sheet"]
    assert not b.upload(_files(spark, "a", "b"), one, stream=("landing", 0))
    assert {t: rows(a.table(t), "id") for t in before} == before
    _with_chunks(spark, a, one)
    assert a.table("postings").count() > 0
    # the same documents again: replaced, in one commit
    assert b.upload(_files(spark, "a"), one, stream=("landing", 1)) and a._current()[0] == at + 3
    assert a.table("postings").count() == a.table("chunk").count() == 0  # the document's older rows are gone
    assert {t: rows(a.table(t), "id") for t in before} == before


def test_compaction_keeps_what_others_do(pair):
    a, b, (one, two, _) = pair
    for i in range(6):
        a.record_message("s", "user", f"m{i}")
    a.delete_folder(one)
    _racing(a, lambda: b.record_message("s", "user", "late"))
    a.compact("chat_message")
    _racing(a, lambda: b.delete_folder(two))
    a.compact("folder")
    assert names(a) == ["three"] and a.table("chat_message").count() == 7
    state = a._current()[1]
    assert len(state["data"]["chat_message"]) == 2 and len(state["data"]["folder"]) == 1 and len(state["gone"]["folder"]) == 1
    a.append(folder=a.table("folder").withColumn("id", F.lit(two).cast("long")))  # an id that was deleted may come back
    assert a.table("folder").count() == 2


def test_a_dead_writers_lock_is_outbid(pair):
    a, b, _ = pair
    number = a._current()[0] + 1
    assert a._claim(number)  # and never publishes
    real = b._claim
    b._claim = lambda n: real(n, 0.3)
    b.record_message("s", "user", "x")
    assert b._current()[0] == number
    assert a._outbid(number) and a.table("chat_message").count() == 1


def test_many_writers_in_threads(spark, tmp_path):
    root = str(tmp_path / "kb")
    KnowledgeBase(spark, root).create_folder("a")
    done = []

    def write(i):
        kb = KnowledgeBase(spark, root)
        kb.transact(lambda s: Change(rows={"chat_message": kb.spark.range(1).select(F.lit(i).alias("id"))}))
        done.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    kb = KnowledgeBase(spark, root)
    assert rows(kb.table("chat_message"), "id") == [(i,) for i in range(4)] and kb._manifests() == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_stream_equals_the_batch(spark, tmp_path, seed):
    rng, t = random.Random(seed), dt.datetime(2024, 1, 1)
    data = [(d, s, t + dt.timedelta(minutes=m)) for d in range(8) for m, s in enumerate(["started", "reading", "parsing", "done", "started", "error"][: rng.randint(2, 6)])]
    data += [data[3]] + [data[7]]
    want = progress.until_terminal(spark.createDataFrame(data, "document_id long, stage string, ts timestamp").distinct())
    want = rows(want, "document_id", "ts", "stage")
    rng.shuffle(data)
    path = tmp_path / "ev"
    path.mkdir()
    show = lambda x: json.dumps({"document_id": x[0], "stage": x[1], "ts": x[2].isoformat()})
    for i in range(4):
        (path / f"{i}.json").write_text("\n".join(map(show, data[i::4])))
    (path / "9.json").write_text(show((99, "started", t + dt.timedelta(days=2))))  # moves the watermark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema("document_id long, ts timestamp, stage string").option("maxFilesPerTrigger", 1).json(str(path))
        q = progress.until_terminal_stream(events, "1 day").writeStream.format("memory").queryName(f"ended{seed}").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        assert rows(spark.table(f"ended{seed}"), "document_id", "ts", "stage") == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_requests_in_flight(spark):
    chunks = spark.createDataFrame([(i, f"{i:03d} " + "x" * 90) for i in range(40)], "id long, text string")
    class Model:
        """Answers with the number of requests open at that time; sent to the worker as it is."""

        def __call__(self, text):
            import time

            box = self.__dict__
            box.setdefault("open", []).append(1)  # list operations are atomic
            n = len(box["open"])
            time.sleep(0.03)
            box["open"].pop()
            tried = box.setdefault("tried", {})
            tried[text[:3]] = tried.get(text[:3], 0) + 1
            if text.startswith("00") and tried[text[:3]] == 1:
                raise RuntimeError("busy")  # the first ten are refused once
            return "" if text.startswith("039") else f"TECHNICAL\n{text[:3]}\nBUSINESS\n{n}\nKEYWORDS\nk\nEND"

    got = {r["id"]: r["technical"] for r in enrich.enrich(chunks.coalesce(1), Model(), 3, pause=0.01).collect()}
    assert got == {i: "" if i == 39 else f"{i:03d}" for i in range(40)}
    peaks = [int(r["business"]) for r in enrich.enrich(chunks.coalesce(1), Model(), 3, pause=0.01).collect() if r["business"]]
    assert max(peaks) == 3
