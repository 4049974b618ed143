"""Table schemas and idempotent table creation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

RUN = "struct<text:string,color:string,bold:boolean,italic:boolean,underline:boolean>"

DDL: dict[str, str] = {
    "folder": "id long, name string, color string, created_at timestamp",
    "document": "id long, folder_id long, filename string, file_path string, file_size long, doc_metadata string, status string, enrich_status string, error_msg string, uploaded_at timestamp, indexed_at timestamp",
    "sheet": "id long, document_id long, name string, sheet_index int, sheet_type string, classifier_confidence double, screenshot_path string, raw_text string",
    "chunk": "id long, sheet_id long, document_id long, folder_id long, text string, markdown string, chunk_metadata string, hierarchy_path string, chunk_order int, created_at timestamp",
    "chunk_summary": "id long, chunk_id long, perspective string, text string",
    "image": "id long, sheet_id long, file_path string, anchor_cell string, vl_description string, related_annotations string",
    "change_log": "id long, document_id long, log_date string, description string, tags array<string>",
    "data_dict": "id long, document_id long, sheet_id long, table_name string, table_name_en string, column_name string, column_name_en string, description string",
    "chat_message": "id long, session_id string, role string, content string, context_mode string, citations string, confidence int, created_at timestamp",
    "chunk_vec": "chunk_id long, embedding array<float>",
    "summary_vec": "summary_id long, embedding array<float>",
    "postings": "kind string, ref_id long, term string, pos int",
    "grams": "ref_id long, gram string",
    "image_blob": "digest string, format string, bytes binary",
    "enrich_attempt": "chunk_id long, attempted_at timestamp",
    "progress": "document_id long, ts timestamp, stage string, message string, current int, total int",
    # cell grid
    "sheets": "document_id long, sheet_index int, name string, max_row int, max_col int, has_images boolean, merged_ranges array<string>",
    "cells": f"document_id long, sheet_index int, row int, col int, col_letter string, text string, runs array<{RUN}>, font_color string, fill_color string, bold boolean, italic boolean, font_size double, is_merge_anchor boolean, merged_range string, hyperlink string, indent_level int",
    "images": "document_id long, sheet_index int, image_index int, bytes binary, format string, anchor_cell string",
}

#: Column by which a stored table is partitioned.
PARTITION = {"chunk": "folder_id"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """CREATE TABLE IF NOT EXISTS for every stored table; running it again changes nothing."""
    for name, ddl in DDL.items():
        part = f" PARTITIONED BY ({PARTITION[name]})" if name in PARTITION else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{part}")
