import datetime as dt
import io
import json
import zipfile

from helpers import rows
from pyspark.sql import functions as F

from gridquill import schemas
from gridquill.operators import classify, parsers
from gridquill.sources import xlsx
from gridquill.streaming import progress

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook() -> bytes:
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets><sheet name="表紙" sheetId="1" r:id="rId1"/><sheet name="broken" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{M}"><si><t>  DBL-10 </t></si><si><r><rPr><b/><color rgb="FFFF0000"/></rPr><t>red </t></r><r><t>plain</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{M}"><fonts><font><sz val="11"/></font><font><b/><sz val="14"/><color indexed="4"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill></fills><cellXfs><xf fontId="0" fillId="0" numFmtId="0"/><xf fontId="1" fillId="1" numFmtId="0"/><xf fontId="0" fillId="0" numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{M}" xmlns:r="{R}"><sheetData><row r="1"><c r="B1" t="s" s="1"><v>0</v></c><c r="C1"/></row><row r="2"><c r="C2" t="s"><v>1</v></c><c r="D2" s="2"><v>44552</v></c></row><row r="3"><c r="B3"><f>SUM(A1:A2)</f><v>3</v></c><c r="C3"><v>1.5</v></c><c r="AA3" t="inlineStr"><is><t>　inline　</t></is></c></row></sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells><drawing r:id="rId9"/></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="rId9" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": f'<xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{R}"><xdr:oneCellAnchor><xdr:from><xdr:col>1</xdr:col><xdr:row>4</xdr:row></xdr:from><xdr:pic><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="rId1" Target="../media/image1.PNG"/></Relationships>',
        "xl/worksheets/sheet2.xml": "<not xml",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
        z.writestr("xl/media/image1.PNG", b"picture")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(workbook())
    (tmp_path / "in/b.xlsx").write_bytes(b"not a zip")
    got = xlsx.read_workbooks(spark, str(tmp_path / "in"))
    assert rows(got["sheets"], "sheet_index", "name", "max_row", "max_col", "has_images") == [(0, "表紙", 3, 27, True)]
    assert rows(got["errors"], "sheet_index") == [(1,), (None,)]
    c = {(r["row"], r["col"]): r for r in got["cells"].collect()}
    assert {k: v["text"] for k, v in c.items()} == {(1, 2): "DBL-10", (2, 3): "red plain", (2, 4): "2021-12-22 00:00:00", (3, 2): "=SUM(A1:A2)", (3, 3): "1.5", (3, 27): "inline"}
    a = c[(1, 2)]
    assert (a["bold"], a["font_color"], a["fill_color"], a["merged_range"], a["is_merge_anchor"], a["indent_level"]) == (True, "#0000FF", "#00FF00", "B1:C1", True, 0)
    assert (c[(2, 3)]["font_color"], c[(2, 3)]["bold"], c[(2, 3)]["indent_level"], len(c[(2, 3)]["runs"])) == ("#FF0000", True, 1, 2)
    assert rows(got["images"], "image_index", "anchor_cell", "format") == [(0, "B5", "png")]
    # into the operators
    grid = got["cells"].withColumnRenamed("document_id", "sheet_id")
    sheets = got["sheets"].select(F.col("document_id").alias("sheet_id"), "name", "has_images")
    assert classify.classify(sheets, grid).first()["sheet_type"] == "cover"
    assert parsers.cover_metadata(grid).first()["jira_codes"] == ["DBL-10"]


def test_scan_guard_keeps_whole_rows():
    cells, _, _ = xlsx.Workbook(workbook()).read_sheet("xl/worksheets/sheet1.xml", 2)
    assert len(cells) == 3


def test_create_tables_twice(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS gq")
    for _ in range(2):
        schemas.create_tables(spark, "gq")
    assert spark.table("gq.chunk").count() == 0
    spark.sql("DROP DATABASE gq CASCADE")


def events(spark):
    t = dt.datetime(2024, 1, 1)
    data = [(1, "started", 0), (1, "parsing", 1), (1, "done", 2), (1, "started", 3), (2, "started", 0), (2, "error", 5), (3, "reading", 1)]
    return spark.createDataFrame([(d, s, t + dt.timedelta(hours=h)) for d, s, h in data], "document_id long, stage string, ts timestamp")


def test_progress(spark):
    assert rows(progress.latest(events(spark)), "document_id", "stage", "finished", "n_events") == [(1, "started", False, 4), (2, "error", True, 2), (3, "reading", False, 1)]
    assert progress.until_terminal(events(spark)).count() == 6


def test_progress_stream(spark, tmp_path):
    path = tmp_path / "ev"
    path.mkdir()
    lines = [json.dumps({"document_id": r["document_id"], "stage": r["stage"], "ts": r["ts"].isoformat()}) for r in events(spark).collect()]
    (path / "a.json").write_text("\n".join(lines))
    q = progress.windows(progress.event_stream(spark, str(path)), "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 7


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.xlsx").write_bytes(workbook())
    seen = []
    q = progress.ingest_stream(spark, str(tmp_path / "land"), str(tmp_path / "ck2"), lambda df, i: seen.append(xlsx.from_files(df.select("path", "content"))["cells"].count()))
    q.awaitTermination(60)
    assert seen == [6]
