"""Inspection views of grids and parsed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inspect_sheets(sheets: DataFrame, cells: DataFrame, with_cells: bool = False, ranges: int = 50) -> DataFrame:
    """Sheets with their sizes, up to ``ranges`` merged ranges and, if asked for, their cells."""
    per = cells.groupBy("sheet_id").agg(F.count("*").alias("n_cells"), F.countDistinct("row").alias("n_rows"), *([F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("cells")] if with_cells else []))
    s = sheets.withColumn("merged_ranges", F.slice("merged_ranges", 1, ranges)) if "merged_ranges" in sheets.columns else sheets
    return s.join(per, "sheet_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cells", "n_rows")})


def preview_chunks(chunks: DataFrame, first: int = 3, text_chars: int = 200, markdown_chars: int = 400) -> DataFrame:
    """The first chunks of every sheet, cut to a preview's length."""
    i = F.row_number().over(Window.partitionBy("sheet_id").orderBy("chunk_order"))
    cut = {"text": F.left("text", F.lit(text_chars))} | ({"markdown": F.left("markdown", F.lit(markdown_chars))} if "markdown" in chunks.columns else {})
    return chunks.withColumn("i", i).where(F.col("i") <= first).drop("i").withColumns(cut)


def output_counters(sheets: DataFrame, **outputs: DataFrame) -> DataFrame:
    """Per sheet the number of rows of each output (chunks, images, logs, dictionary rows)."""
    out = sheets.select("sheet_id")
    for name, df in outputs.items():
        out = out.join(df.groupBy("sheet_id").agg(F.count("*").alias(name)), "sheet_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def totals(folder_listing: DataFrame) -> DataFrame:
    return folder_listing.agg(F.sum(F.coalesce("n_documents", F.lit(0))).alias("n_documents"), F.sum(F.coalesce("n_chunks", F.lit(0))).alias("n_chunks"))
