"""Sheet classification: features by aggregation, then one ordered decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

LEAST_CONFIDENCE = 0.55


def header_rows(cells: DataFrame, top: int = 8) -> DataFrame:
    """sheet_id, header_row: the first of the ``top`` rows with >= 3 cells and any bold or fill,
    else the first row with >= 3 cells."""
    rows = cells.groupBy("sheet_id", "row").agg(F.count("*").alias("n"), F.bool_or(F.col("bold") | F.col("fill_color").isNotNull()).alias("marked"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("sheet_id").orderBy("row")))
    wide = F.col("n") >= 3
    out = rows.groupBy("sheet_id").agg(F.min(F.when(wide & F.col("marked") & (F.col("i") <= top), F.col("row"))).alias("a"), F.min(F.when(wide, F.col("row"))).alias("b"))
    return out.select("sheet_id", F.coalesce("a", "b").alias("header_row")).where("header_row is not null")


def basic_features(cells: DataFrame) -> DataFrame:
    """Per sheet: cells, rows, share of rows led by a date, indent levels, font colours."""
    # the levels are the ranks of the rows' left-most columns, so there are as many as such columns
    dated = F.min_by(F.col("text").rlike(X.ROW_DATE).cast("int"), "col").alias("dated")
    rows = cells.groupBy("sheet_id", "row").agg(dated, F.count("*").alias("n"), F.min("col").alias("leftmost"))
    per = rows.groupBy("sheet_id").agg(
        F.sum("n").alias("n_cells"),
        F.count("*").alias("n_rows"),
        F.sum("dated").alias("date_rows"),
        F.countDistinct("leftmost").alias("n_indents"),
    )
    colors = cells.where("font_color is not null").groupBy("sheet_id").agg(F.countDistinct("font_color").alias("n_colors"))
    return per.join(colors, "sheet_id", "left").withColumn("n_colors", F.coalesce("n_colors", F.lit(0)))


def table_features(cells: DataFrame) -> DataFrame:
    """sheet_id, body_rows, alike_rows: body rows sharing >= max(2, headers - 1) header columns."""
    head = header_rows(cells)
    columns = cells.join(head, "sheet_id").where("row = header_row").select("sheet_id", "col")
    width = columns.groupBy("sheet_id").agg(F.count("*").alias("width"))
    body = cells.join(head, "sheet_id").where("row > header_row").select("sheet_id", "row", "col")
    shared = body.join(columns.withColumn("hit", F.lit(1)), ["sheet_id", "col"], "left").groupBy("sheet_id", "row").agg(F.count("hit").alias("shared"))
    return shared.join(width, "sheet_id").groupBy("sheet_id").agg(F.count("*").alias("body_rows"), F.sum((F.col("shared") >= F.greatest(F.lit(2), F.col("width") - 1)).cast("int")).alias("alike_rows"))


def features(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per sheet (also for sheets without cells) with the four structural tests."""
    f = sheets.select("sheet_id", "name", "has_images").join(basic_features(cells), "sheet_id", "left").join(table_features(cells), "sheet_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_cells", "n_rows", "date_rows", "n_indents", "n_colors", "body_rows", "alike_rows")}
    f = f.withColumns(zero)
    return f.withColumns(
        {
            "is_cover": (F.col("n_cells") <= 6) & (F.col("n_rows") <= 6),
            "is_history": (F.col("n_rows") > 0) & (F.col("date_rows") * 2 >= F.col("n_rows")) & (F.col("n_rows") <= 50),
            "is_table": (F.col("n_rows") >= 4) & (F.col("body_rows") >= 3) & (F.col("alike_rows") * 10 >= F.col("body_rows") * 6),
            "is_memo": ((F.col("n_indents") >= 3).cast("int") + (F.col("n_colors") >= 2).cast("int") + (F.col("n_rows") >= 15).cast("int")) >= 2,
            "hint": X.name_hint(F.col("name")),
        }
    )


def classify(sheets: DataFrame, cells: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """sheet_id, sheet_type, confidence, used_vl, reasons.

    ``vision`` (sheet_id, vl_type) takes part only where nothing else decided, as does the second
    pass of the reference's pipeline, which looks at sheets below LEAST_CONFIDENCE."""
    f = features(sheets, cells)
    f = f.join(vision.select("sheet_id", "vl_type"), "sheet_id", "left") if vision is not None else f.withColumn("vl_type", F.lit(None).cast("string"))
    hint = F.coalesce("hint", F.lit(""))
    either = lambda kind, a, b: F.when(hint == kind, a).otherwise(b)
    image = F.when(hint.isin("cover", "history", "index"), F.col("hint")).otherwise("screen")
    kind = (
        F.when(F.col("has_images"), image)
        .when(F.col("is_cover"), "cover")
        .when(F.col("is_history"), "history")
        .when(F.col("is_table"), "table")
        .when(F.col("is_memo"), "memo")
        .otherwise(F.coalesce("hint", "vl_type", F.lit("unknown")))
    )
    sure = (
        F.when(F.col("has_images"), F.when(hint == "screen", 0.95).when(image != "screen", 0.88).otherwise(0.80))
        .when(F.col("is_cover"), either("cover", 0.90, 0.70))
        .when(F.col("is_history"), either("history", 0.93, 0.75))
        .when(F.col("is_table"), either("table", 0.92, 0.78))
        .when(F.col("is_memo"), either("memo", 0.85, 0.65))
        .when(F.col("hint").isNotNull(), LEAST_CONFIDENCE)
        .when(F.col("vl_type").isNotNull(), 0.6)
        .otherwise(0.0)
    )
    undecided = ~(F.col("has_images") | F.col("is_cover") | F.col("is_history") | F.col("is_table") | F.col("is_memo")) & F.col("hint").isNull()
    why = F.array_compact(
        F.array(
            F.when(F.col("hint").isNotNull(), F.concat(F.lit("name hints at "), "hint")),
            F.when(F.col("has_images"), "has images"),
            F.when(F.col("is_cover"), "few cells"),
            F.when(F.col("is_history"), "rows begin with dates"),
            F.when(F.col("is_table"), "rows share the header's columns"),
            F.when(F.col("is_memo"), "indents, colours or length of a memo"),
            F.when(undecided & F.col("vl_type").isNotNull(), "vision"),
        )
    )
    return f.select("sheet_id", kind.alias("sheet_type"), sure.alias("confidence"), (undecided & F.col("vl_type").isNotNull()).alias("used_vl"), why.alias("reasons"))


def needs_screenshot(classified: DataFrame, smart: bool = True) -> DataFrame:
    """Adds need_screenshot: always unless smart; else for covers, screens, unknown and unsure ones."""
    return classified.withColumn("need_screenshot", F.lit(not smart) | F.col("sheet_type").isin("cover", "screen", "unknown") | (F.col("confidence") < LEAST_CONFIDENCE))
