"""Hand-made grids; expected values worked out from the rules."""

import random
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridquill.functions import text as X
from gridquill.operators import cells, classify, parsers

GRID = "sheet_id long, row int, col int, text string, bold boolean, font_color string, fill_color string"


def grid(spark, items):
    """items: (row, col, text, bold, color) of sheet 1."""
    return spark.createDataFrame([(1, r, c, t, b, k, None) for r, c, t, b, k in items], GRID)


def sheets(spark, name, has_images=False):
    return spark.createDataFrame([(1, name, has_images)], "sheet_id long, name string, has_images boolean")


def kind(spark, name, items, has_images=False):
    r = classify.classify(sheets(spark, name, has_images), grid(spark, items)).first()
    return r["sheet_type"], r["confidence"]


TABLE = [(1, 1, "テーブル名", True, None), (1, 2, "カラム名", True, None), (1, 3, "カラム名英語", True, None), (1, 4, "説明", True, None)] + [
    (r, c, t, False, None)
    for r, c, t in [(2, 1, "顧客"), (2, 2, "顧客ID"), (2, 3, "customer_id"), (2, 4, "主キー"), (3, 2, "氏名"), (3, 3, "name"), (4, 1, "受注"), (4, 2, "受注ID"), (4, 3, "order_id"), (4, 4, "主キー"), (5, 2, "金額"), (5, 3, "amount"), (5, 4, "合計")]
]


def test_table_with_dictionary(spark):
    g, s = grid(spark, TABLE), sheets(spark, "テーブル定義")
    assert kind(spark, "テーブル定義", TABLE) == ("table", 0.92)
    d = {r["row"]: r for r in parsers.data_dictionary(g).collect()}
    assert len(d) == 4
    assert (d[3]["table_name"], d[3]["table_name_en"], d[3]["column_name"], d[3]["column_name_en"], d[3]["description"]) == ("顧客", "", "氏名", "name", "主キー")
    assert (d[5]["table_name"], d[5]["description"]) == ("受注", "合計")
    (c,) = parsers.table_chunks(g, s).collect()
    assert (c["row_min"], c["row_max"], c["row_count"]) == (2, 5, 4)
    assert c["text"].split("\n")[0] == "テーブル名: 顧客 ; カラム名: 顧客ID ; カラム名英語: customer_id ; 説明: 主キー"


def _batches(n, size):
    out, i = [], 0
    while i < n:
        out.append(list(range(i, min(n, i + size))))
        i += size - 1 if size > 4 else size
    return out


@pytest.mark.parametrize("size", [1, 4, 5, 20])
def test_batches(spark, size):
    for n in (0, 1, 19, 20, 39, 57, 96):
        got = spark.range(n).select("id", F.explode(parsers.batch_numbers(F.col("id"), size)).alias("b")).groupBy("b").agg(F.sort_array(F.collect_list("id")).alias("x")).orderBy("b").collect()
        assert [r["x"] for r in got] == _batches(n, size), n


HISTORY = [(1, 1, "日付"), (1, 2, "内容"), (2, 1, "2021/12/1"), (2, 2, "DBL-10 初版"), (3, 1, "2022/3/5"), (3, 2, "KAIZEN-2635 DBL-10 対応"), (4, 1, "2022/10/20"), (4, 2, "- 誤字修正")]


def test_history(spark):
    items = [(r, c, t, False, None) for r, c, t in HISTORY]
    assert kind(spark, "変更履歴", items) == ("history", 0.93)
    got = rows(parsers.history_entries(grid(spark, items)), "chunk_order", "log_date", "description", "tags")
    assert got == [(0, "2021-12-01", "DBL-10 初版", ["DBL-10"]), (1, "2022-03-05", "KAIZEN-2635 DBL-10 対応", ["DBL-10", "KAIZEN-2635"]), (2, "2022-10-20", "誤字修正", [])]
    assert kind(spark, "変更履歴", items[:6])[0] == "cover"


def test_memo(spark):
    g = grid(spark, [(1, 1, "概要", True, None), (2, 2, "前提条件", False, None), (3, 3, "予算は月次で反映する", False, "#FF0000"), (4, 2, "例外", False, None), (5, 3, "各月対応", False, None), (6, 1, "まとめ", False, None)])
    legend = spark.createDataFrame([(1, "#FF0000", "DBL-179")], "sheet_id long, color string, tag string")
    codes = spark.createDataFrame([(1, ["DBL-10"])], "sheet_id long, jira_codes array<string>")
    got = parsers.memo_chunks(g, sheets(spark, "仕様"), legend, codes).orderBy("chunk_order").collect()
    assert [(r["text"], r["hierarchy_path"], r["colors"], r["jira_tags"]) for r in got] == [
        ("概要", "仕様 > 概要", [], ["DBL-10"]),
        ("予算は月次で反映する", "仕様 > 概要 > 前提条件", ["#FF0000"], ["DBL-179"]),
        ("各月対応 まとめ", "仕様 > 概要 > 例外", [], ["DBL-10"]),
    ]
    assert got[2]["markdown"] == "## 概要\n### 例外\n    - 各月対応\n- まとめ"


def _split(lines, limit=1200):
    if sum(n for n, _ in lines) <= limit:
        return [list(range(len(lines)))]
    out, cur, size = [], [], 0
    for i, (n, indent) in enumerate(lines):
        if cur and size + n > limit and indent <= lines[cur[-1]][1]:
            out.append(cur)
            cur, size = [], 0
        cur.append(i)
        size += n
    return out + [cur]


def test_memo_split_matches_loop(spark):
    rng = random.Random(1)
    bodies = [[(700, 0), (600, 0), (100, 0), (1150, 0), (90, 0)], [(700, 0), (500, 0)]] + [[(rng.randint(1, 900), rng.randint(0, 3)) for _ in range(rng.randint(1, 9))] for _ in range(30)]
    data = [(i, [(j, ind, f"{j}" + "x" * (n - 1), []) for j, (n, ind) in enumerate(b)]) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(data, "id int, body array<struct<row:int,indent:int,text:string,colors:array<string>>>")
    got = df.select("id", F.transform(parsers.split_body(F.col("body")), lambda p: F.transform(p, lambda x: x["row"])).alias("p")).orderBy("id").collect()
    assert [r["p"] for r in got] == [_split(b) for b in bodies]


def test_cover_and_vision_legend(spark):
    g = grid(spark, [(1, 1, "詳細設計書", False, None), (2, 1, "DBL-10, KAIZEN-2635", False, None), (3, 1, "2021/12/22", False, None)])
    vision = spark.createDataFrame([(1, '```json\n{"title":"T","color_legend":[{"color_hex":"#ff0000","label":"DBL-179"}]}\n```')], "sheet_id long, payload string")
    r = parsers.cover_metadata(g, vision).first()
    assert (r["jira_codes"], r["version"], r["title"]) == (["DBL-10", "KAIZEN-2635"], "2021/12/22", "T")
    assert [tuple(x) for x in r["color_map"]] == [("#FF0000", "DBL-179")]
    assert parsers.cover_metadata(g).first()["title"] == ""


@pytest.mark.parametrize(("name", "images", "want"), [("Sheet1", False, ("cover", 0.70)), ("画面", True, ("screen", 0.95)), ("表紙", True, ("cover", 0.88)), ("Sheet1", True, ("screen", 0.80))])
def test_empty_sheets_and_images(spark, name, images, want):
    assert kind(spark, name, [], images) == want


def test_name_hints_and_name_only(spark):
    names = {"表紙": "cover", "更新履歴": "history", "画面一覧": "index", "guide": "screen", "data_dict": "table", "note": "memo", "Sheet1": None}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r["h"] for r in df.select("name", X.name_hint(F.col("name")).alias("h")).collect()} == names
    items = [(r, 1, "plain words", False, None) for r in range(1, 9)]
    assert kind(spark, "note", items) == ("memo", 0.55)
    assert kind(spark, "zzz", items) == ("unknown", 0.0)


def test_scan_guard_and_ladder(spark):
    g = grid(spark, [(r, c, "x", False, None) for r in range(1, 4) for c in range(1, 4)])
    assert cells.scan_guard(g, 5).count() == 6
    g = grid(spark, [(1, 4, "a", False, None), (2, 6, "b", False, None), (3, 4, "c", False, None), (4, 9, "d", False, None)])
    assert rows(cells.with_indent(g), "row", "indent_level") == [(1, 0), (2, 1), (3, 0), (4, 2)]


def test_duplicate_headers_take_the_right_most(spark):
    g = grid(spark, [(1, 1, "h", True, None), (1, 2, "h", True, None), (1, 3, "k", True, None), (2, 1, "a", False, None), (2, 2, "b", False, None), (2, 3, "c", False, None)])
    r = parsers.table_records(parsers.table_values(g)).first()
    assert (r["text"], r["markdown_row"]) == ("h: b ; k: c", "| b | b | c |")


def test_empty_grid(spark):
    g, s = grid(spark, []), sheets(spark, "x")
    for df in (parsers.history_entries(g), parsers.table_chunks(g, s), parsers.memo_chunks(g, s), parsers.data_dictionary(g), cells.dump_text(g)):
        assert df.count() == 0


@pytest.mark.parametrize("tall", [False, True])
def test_tall_tables_are_cut_into_blocks(spark, monkeypatch, tall):
    """One sheet of 400 rows: values filled across blocks, batches numbered across them, no task with a whole column, in table_forward_fill and table_batches alike."""
    rng = random.Random(4)
    monkeypatch.setattr(parsers, "TASK_CELLS", 60)
    if tall:
        monkeypatch.setattr(parsers, "BLOCK_ROWS", 8)
    grid = {(r, c): rng.choice(["", "", "", None, f"v{r}.{c}"]) for r in range(2, 402) for c in (1, 2, 3) if rng.random() < 0.5 and not (c == 2 and r < 40)}
    data = [(1, 1, c, f"h{c}", True) for c in (1, 2, 3)] + [(1, r, c, t, False) for (r, c), t in grid.items()]
    g = spark.createDataFrame(data, "sheet_id long, row int, col int, text string, bold boolean").withColumn("fill_color", F.lit(None).cast("string"))
    want, last = {}, {}
    for r in sorted({r for r, _ in grid}):
        for c in (1, 2, 3):
            last[c] = grid.get((r, c)) or last.get(c, "")
            want[r, c] = last[c]
    values = parsers.table_values(g)
    got = values.withColumn("task", F.spark_partition_id()).collect()
    assert {(x["row"], x["col"]): x["value"] for x in got} == want and len(got) == len(want)
    if tall:
        assert max(Counter(x["task"] for x in got).values()) < 300
    records = [r for r in sorted({r for r, _ in want}) if any(want[r, c] for c in (1, 2, 3))]
    batches = {}
    for i, r in enumerate(records):
        batches.setdefault(i // 19, []).append(r)
        if i and i % 19 == 0:
            batches[i // 19 - 1].append(r)
    out = parsers.table_chunks(g, spark.createDataFrame([(1, "t")], "sheet_id long, name string")).collect()
    assert {x["chunk_order"]: (x["row_min"], x["row_max"], x["row_count"]) for x in out} == {b: (r[0], r[-1], len(r)) for b, r in batches.items()}
    for x in out:
        shown = [" ; ".join(f"h{c}: {want[r, c]}" for c in (1, 2, 3) if want[r, c]) for r in batches[x["chunk_order"]]]
        assert x["text"] == "\n".join(shown)


def test_dispatch_classifies_and_places_cells_once(spark):
    """The parsers read stored cells of their types; none of them carries the classification in its plan."""
    g, s = grid(spark, TABLE), sheets(spark, "テーブル定義")
    out = parsers.dispatch(s, g, classify.classify(s, g))
    assert {r["kind"] for r in out.collect()} == {"table_batch"}
    assert "alike_rows" not in out._jdf.queryExecution().optimizedPlan().toString()
    f = classify.classify(s, g)
    assert "alike_rows" in f._jdf.queryExecution().optimizedPlan().toString()
