from pyspark.sql import functions as F
from test_sources_streaming import workbook

from gridquill.engine import KnowledgeBase
from gridquill.operators import preview


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    a, b = kb.create_folder("first"), kb.create_folder("second")
    kb.update_folder(b, name="renamed")
    files = spark.createDataFrame([("/in/a.xlsx", bytearray(workbook())), ("/in/bad.xlsx", bytearray(b"no zip"))], "path string, content binary")
    kb.upload(files, a)
    docs = {r["filename"]: r for r in kb.list_documents().collect()}
    assert docs["bad.xlsx"]["status"] == "failed" and docs["a.xlsx"]["status"] == "ready"
    assert "DBL-10" in docs["a.xlsx"]["doc_metadata"]
    assert {r["name"]: r["n_documents"] for r in kb.list_folders().collect()} == {"first": 2, "renamed": 0}
    # chunks written by hand, then found by text, vector and identifier
    sheet = kb.table("sheet").first()
    text = "月次の予算は BUDGED_COST_1 に反映する " + "x" * 80
    kb.append(chunk=spark.createDataFrame([(1, sheet["id"], sheet["document_id"], a, text)], "id long, sheet_id long, document_id long, folder_id long, text string"))
    chunk = kb.table("chunk")
    from gridquill.operators import search

    kb.append(postings=search.postings(chunk, "id", "text"), chunk_vec=chunk.select(F.col("id").alias("chunk_id"), kb.embed(F.col("text")).alias("embedding")))
    kb.enrich(lambda t: "TECHNICAL\nbudget table\nBUSINESS\nmonthly\nKEYWORDS\ncost\nEND")
    assert kb.table("chunk_summary").count() == 3
    q = spark.createDataFrame([(1, "BUDGED_COST_1", None), (2, "BUDGED_COST_1", b), (3, "budget table", a)], "query_id long, question string, folder_id long")
    hits = kb.search(q).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in hits} == {(1, 1), (3, 1)}
    assert "exact" in [r["sources"] for r in hits if r["query_id"] == 1][0] and "fts" in [r["sources"] for r in hits if r["query_id"] == 3][0]
    ctx = {r["query_id"]: r["context"] for r in kb.answer_context(q).collect()}
    assert ctx[1].startswith("[#1] 文件: a.xlsx") and not ctx[2].startswith("[#")
    assert kb.chunk(1).first()["summaries"][0]["perspective"] == "business"
    kb.record_message("s", "assistant", "ok\n__CONFIDENCE__: 7")
    assert kb.table("chat_message").select("content", "confidence").first() == ("ok", 7)
    shown = preview.preview_chunks(kb.table("chunk"), text_chars=5).where("id = 1").first()
    assert shown["text"] == text[:5]
    kb.delete_folder(a)
    left = {t: kb.table(t).count() for t in ("folder", "document", "sheet", "chunk", "chunk_summary", "chunk_vec", "summary_vec", "postings", "image")}
    assert left == {"folder": 1} | dict.fromkeys(("document", "sheet", "chunk", "chunk_summary", "chunk_vec", "summary_vec", "postings", "image"), 0)


def test_an_upload_again_replaces_and_sheets_are_read_once(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    folder = kb.create_folder("first")
    files = spark.createDataFrame([("/in/a.xlsx", bytearray(workbook()))], "path string, content binary")
    kb.upload(files, folder)
    names = ("document", "sheet", "chunk", "chunk_vec", "postings", "image", "image_blob")
    before = {t: kb.table(t).count() for t in names}
    assert before["image_blob"] == kb.table("image").select("file_path").distinct().count() and before["sheet"] > 0
    kb.upload(files, folder)
    assert {t: kb.table(t).count() for t in names} == before
    text = "a long text " * 20
    kb.append(chunk=spark.createDataFrame([(1, text, None), (2, text, '{"enrich_eligible":false}')], "id long, text string, chunk_metadata string"))
    # what has been asked for once, even without an answer, is not asked for again
    kb.enrich(lambda t: "")
    kb.enrich(lambda t: "")
    assert [r["chunk_id"] for r in kb.table("enrich_attempt").collect()] == [1]


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "kb")
    KnowledgeBase(spark, root).create_folder("a")

    def write(i):
        kb = KnowledgeBase(spark, root)
        for j in range(3):
            kb.record_message(f"s{i}", "user", f"{i} {j}")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    kb = KnowledgeBase(spark, root)
    assert kb.table("chat_message").count() == 9 and kb.table("folder").count() == 1


def test_covers_give_their_tags_to_the_other_sheets(spark):
    from gridquill.operators import parsers

    sheets = spark.createDataFrame([(1, 9, 0, "cover"), (2, 9, 1, "note"), (3, 9, 2, "plain"), (4, 8, 0, "other"), (5, 9, 3, "screen")], "sheet_id long, document_id long, sheet_index int, name string")
    kinds = spark.createDataFrame([(1, "cover"), (2, "memo"), (3, "memo"), (4, "memo"), (5, "screen")], "sheet_id long, sheet_type string")
    cell = [(1, 1, 1, "DBL-10", None), (2, 1, 1, "a red line of text", "#FF0000"), (3, 1, 1, "a plain line", None), (4, 1, 1, "elsewhere", "#FF0000"), (5, 1, 1, "button", None)]
    cells = spark.createDataFrame(cell, "sheet_id long, row int, col int, text string, font_color string").withColumns({"bold": F.lit(False), "fill_color": F.lit(None).cast("string")})
    vision = spark.createDataFrame([(1, '{"color_legend":[{"color_hex":"#FF0000","label":"DBL-179"}]}')], "sheet_id long, payload string")
    out = parsers.dispatch(sheets, cells, kinds, vision=vision).collect()
    assert {r["sheet_id"]: r["jira_tags"] for r in out if r["kind"] == "memo_section"} == {2: ["DBL-179"], 3: ["DBL-10"], 4: []}
    assert [r["text"] for r in out if r["kind"] == "screen"] == ["button"]
    images = spark.createDataFrame([(5, 0, "B2", '{"screen_title": "Login"}')], "sheet_id long, image_index int, anchor_cell string, description string")
    out = parsers.dispatch(sheets, cells, kinds, images, vision).where("kind = 'screen'").first()
    assert "**画面标题**: Login" in out["markdown"]


def test_stored_index_and_probes(spark, sf):
    from gridquill.operators import search
    from gridquill.plans import catalogue
    from gridquill.sources import stand_in as S

    v = S.read(spark, sf, "embeddings").select(F.col("vec_id").alias("ref_id"), "embedding")
    q = v.where("ref_id % 100 = 0").withColumnRenamed("ref_id", "query_id")
    true = {(r["query_id"], r["ref_id"]) for r in search.knn(v, q, 10).collect()}
    got = {(r["query_id"], r["ref_id"]) for r in catalogue.ivf_recall(spark, sf).collect()}
    assert len(true & got) >= 0.9 * len(true)
    empty = search.knn(v, q.where("false"), 10)
    assert empty.count() == 0
