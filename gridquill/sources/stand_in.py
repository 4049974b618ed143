"""Reference-shaped tables derived from the driver's tables (there are no workbooks in them).

folders are sources, documents are documents, chunks are non-empty lines, vectors are
embeddings; sheets come in three families: prose (one per document), parts (one per brand, a
table) and orders (one per customer, a history).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("try_cast(substring(source, 4) as bigint)").alias("folder_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("n_chars").alias("file_size"),
        "lang",
    )
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.to_json(F.struct("quality", "toxic")).alias("doc_metadata"))
    return d.join(labels, "id", "left")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.expr("try_cast(substring(source, 4) as bigint)").alias("id"), F.col("source").alias("name")).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per non-empty line; sheets are documents."""
    folder = documents(spark, sf_dir).select("id", "folder_id")
    out = lines(spark, sf_dir).where("trim(line) <> ''").join(folder, F.col("id") == F.col("doc_id"))
    return out.select((F.col("doc_id") * 1000 + F.col("line_no")).alias("id"), F.col("doc_id").alias("sheet_id"), F.col("doc_id").alias("document_id"), "folder_id", F.col("line").alias("text"), F.col("line_no").alias("chunk_order"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chunk_id, perspective, text, embedding from the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    kinds = F.array(F.lit("technical"), F.lit("business"), F.lit("keywords"))
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("chunk_id"), F.get(kinds, (F.col("vec_id") % 3).cast("int")).alias("perspective"), F.concat(F.lit("summary "), F.col("label").cast("string")).alias("text"), "embedding")


def prose_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family A: row is the line, col the place in the ' | ' split, shifted by length(line) % 3."""
    x = lines(spark, sf_dir).select("doc_id", "line_no", "line", F.posexplode(F.split("line", r" \| ")).alias("p", "text"))
    n = F.length("line")
    return x.where("trim(text) <> ''").select(
        F.col("doc_id").alias("sheet_id"),
        F.col("line_no").alias("row"),
        (F.col("p") + 1 + n % 3).alias("col"),
        "text",
        F.col("line").rlike("^[A-Z]").alias("bold"),
        F.when(n % 5 == 0, "#FF0000").when(n % 5 == 1, "#0000FF").alias("font_color"),
        F.lit(None).cast("string").alias("fill_color"),
    )


def prose_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet_id"), F.concat(F.lit("sheet "), F.col("source")).alias("name"), F.lit(False).alias("has_images"))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family B: a sheet per brand; blank p_type where it repeats the row above."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = read(spark, sf_dir, "part").withColumns({"row": F.row_number().over(w) + 1, "type": F.when(F.col("p_type") == F.lag("p_type").over(w), F.lit("")).otherwise(F.col("p_type"))})
    cols = ["p_brand", "p_name", "p_type", "p_size", "p_retailprice"]
    values = {"p_brand": "p_brand", "p_name": "p_name", "p_type": "type", "p_size": "cast(p_size as string)", "p_retailprice": "cast(cast(p_retailprice as decimal(12,2)) as string)"}
    stack = ", ".join(f"{i + 1}, {values[c]}" for i, c in enumerate(cols))
    sheet = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    body = rows.select(sheet.alias("sheet_id"), "row", F.expr(f"stack(5, {stack}) as (col, text)"), F.lit(False).alias("bold"))
    head = rows.select(sheet.alias("sheet_id")).distinct().select("sheet_id", F.lit(1).alias("row"), F.posexplode(F.array(*(F.lit(c) for c in cols))).alias("p", "text")).select("sheet_id", "row", (F.col("p") + 1).alias("col"), "text", F.lit(True).alias("bold"))
    none = F.lit(None).cast("string")
    return head.unionByName(body.where("text <> ''")).withColumns({"font_color": none, "fill_color": none})


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family C: a sheet per customer; date, then priority."""
    w = Window.partitionBy("o_custkey")
    o = read(spark, sf_dir, "orders").withColumns({"row": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))})
    none = F.lit(None).cast("string")
    return o.select(F.col("o_custkey").alias("sheet_id"), "row", F.expr("stack(2, 1, date_format(o_orderdate, 'yyyy/M/d'), 2, o_orderpriority) as (col, text)")).withColumns({"bold": F.lit(False), "font_color": none, "fill_color": none})


def _xlsx(lines: list[tuple[int, str]], picture: bytes) -> bytes:
    """A workbook of one sheet: key in column B (A if odd), name in C, C1:D1 merged, a picture at B5."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    draw = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
    art = "http://schemas.openxmlformats.org/drawingml/2006/main"
    rows = "".join(
        f'<row r="{i}"><c r="{"A" if k % 2 else "B"}{i}"><v>{k}</v></c><c r="C{i}" t="inlineStr"><is><t xml:space="preserve"> {escape(name)} </t></is></c></row>' for i, (k, name) in enumerate(lines, 1)
    )
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="nations" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="C1:D1"/></mergeCells><drawing r:id="rId9"/></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{pack}"><Relationship Id="rId9" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": f'<x:wsDr xmlns:x="{draw}" xmlns:a="{art}" xmlns:r="{rel}"><x:oneCellAnchor><x:from><x:col>1</x:col><x:row>4</x:row></x:from><x:pic><x:blipFill><a:blip r:embed="rId1"/></x:blipFill></x:pic></x:oneCellAnchor></x:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships xmlns="{pack}"><Relationship Id="rId1" Target="../media/image1.png"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
        z.writestr("xl/media/image1.png", picture)
    return out.getvalue()


def nation_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a real workbook per region, a row per nation in the order of their keys."""
    import pandas as pd

    def build(nations: pd.DataFrame) -> pd.DataFrame:
        n = nations.sort_values("n_nationkey")
        region = int(n["n_regionkey"].iloc[0])
        lines = [(int(k), str(name)) for k, name in zip(n["n_nationkey"], n["n_name"], strict=True)]
        return pd.DataFrame({"path": [f"/in/region-{region}.xlsx"], "content": [_xlsx(lines, f"picture {region}".encode())]})

    return read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(build, "path string, content binary")
