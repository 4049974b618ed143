"""The cell grid: guards, merges, indent, dumps, inspection.

A grid is (sheet_id, row, col, text, bold, font_color, fill_color, ...), one row per non-empty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def non_empty(cells: DataFrame) -> DataFrame:
    return cells.where("text is not null and text <> ''")


def scan_guard(cells: DataFrame, max_cells: int) -> DataFrame:
    """Whole rows while fewer than ``max_cells`` cells came before the row."""
    per_row = cells.groupBy("sheet_id", "row").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sheet_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    kept = per_row.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_cells).select("sheet_id", "row")
    return cells.join(kept, ["sheet_id", "row"], "left_semi")


def with_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """merges: sheet_id, min_row, min_col, merged_range. Marks the anchor cells."""
    m = merges.select("sheet_id", F.col("min_row").alias("row"), F.col("min_col").alias("col"), "merged_range")
    return cells.join(m, ["sheet_id", "row", "col"], "left").withColumn("is_merge_anchor", F.col("merged_range").isNotNull())


def with_indent(cells: DataFrame) -> DataFrame:
    """indent_level: rank of the row's left-most column among the sheet's left-most columns."""
    leftmost = cells.withColumn("leftmost", F.min("col").over(Window.partitionBy("sheet_id", "row")))
    return leftmost.withColumn("indent_level", (F.dense_rank().over(Window.partitionBy("sheet_id").orderBy("leftmost")) - 1).cast("int")).drop("leftmost")


def row_text(sep: str, trim: bool = False) -> Column:
    """Aggregate: a row's cells joined in column order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), sep)
    return F.trim(joined) if trim else joined


def dump_text(cells: DataFrame, sep: str = "\t") -> DataFrame:
    """sheet_id, raw_text: cells joined by ``sep``, rows by newlines."""
    rows = cells.groupBy("sheet_id", "row").agg(row_text(sep).alias("line"))
    return rows.groupBy("sheet_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("raw_text"))


def dump_markdown(cells: DataFrame, sheets: DataFrame, max_rows: int = 200) -> DataFrame:
    """sheet_id, markdown: a title, up to ``max_rows`` indented rows, and a tail naming the rest."""
    grid = cells if "indent_level" in cells.columns else with_indent(cells)
    rows = grid.groupBy("sheet_id", "row").agg(row_text(" | ").alias("line"), F.min_by("indent_level", "col").alias("indent"))
    w = Window.partitionBy("sheet_id")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("row")), "n": F.count("*").over(w)})
    shown = rows.where(F.col("i") <= max_rows).withColumn("line", F.concat(F.expr("repeat('  ', indent)"), F.lit("- "), "line"))
    body = shown.groupBy("sheet_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("body"), F.max("n").alias("n"))
    tail = F.when(F.col("n") > max_rows, F.concat(F.lit("\n... ("), (F.col("n") - max_rows).cast("string"), F.lit(" more rows omitted)"))).otherwise("")
    out = sheets.select("sheet_id", "name").join(body, "sheet_id", "left")
    return out.select("sheet_id", F.concat(F.lit("# Sheet: "), "name", F.coalesce(F.concat(F.lit("\n"), "body", tail), F.lit(""))).alias("markdown"))


def inspect(cells: DataFrame) -> DataFrame:
    """Per sheet: cells, rows with data, sorted distinct colours, fills and indent levels."""
    return with_indent(cells).groupBy("sheet_id").agg(
        F.count("*").alias("n_cells"),
        F.countDistinct("row").alias("n_rows"),
        F.array_join(F.sort_array(F.collect_set("font_color")), ",").alias("colors"),
        F.array_join(F.sort_array(F.collect_set("fill_color")), ",").alias("fills"),
        F.array_join(F.transform(F.sort_array(F.collect_set("indent_level")), lambda x: x.cast("string")), ",").alias("indents"),
    )
