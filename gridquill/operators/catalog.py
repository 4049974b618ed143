"""The catalog: listings, lookups, nesting, writes on immutable tables, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scope(folder_id: int | None = None, document_id: int | None = None) -> Column:
    """Predicate of a scope: whichever of the two is set, ANDed; true when neither is."""
    parts = [F.col(c) == v for c, v in (("folder_id", folder_id), ("document_id", document_id)) if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def scope_mode(folder_id: Column, document_id: Column) -> Column:
    """all, folder:<id> or doc:<id>; the document wins."""
    return F.when(document_id.isNotNull(), F.concat(F.lit("doc:"), document_id.cast("string"))).when(folder_id.isNotNull(), F.concat(F.lit("folder:"), folder_id.cast("string"))).otherwise("all")


def counted(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(by).alias(key)).agg(F.count("*").alias(name))


def folder_listing(folders: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Folders with their numbers of documents and chunks, zero where there are none."""
    out = folders.join(counted(documents, "id", "folder_id", "n_documents"), "id", "left").join(counted(chunks, "id", "folder_id", "n_chunks"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_documents", "n_chunks")})


def document_listing(documents: DataFrame, chunks: DataFrame, folder_id: int | None = None) -> DataFrame:
    d = documents.where(F.col("folder_id") == folder_id) if folder_id is not None else documents
    out = d.join(counted(chunks, "id", "document_id", "n_chunks"), "id", "left")
    return out.withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "doc_metadata": F.coalesce("doc_metadata", F.lit("{}"))})


def nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Parents with a sorted array of their children's columns (empty where there are none)."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def chunk_listing(chunks: DataFrame, sheets: DataFrame, document_id: int | None = None) -> DataFrame:
    c = chunks.where(scope(document_id=document_id))
    return c.join(sheets.select(F.col("sheet_id"), F.col("name").alias("sheet_name")), "sheet_id")


def insert_with_ids(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Rows with ids 1, 2, ... in a natural order: a range sort puts every task's rows in place, and
    only the tasks' row counts, one row each, are summed up to give where a task begins. Both
    uses share one exchange of a fixed number of partitions, so they see the same division."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit(2**33 - 1))})
    per = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = per.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, "part").withColumn("id", F.col("before") + F.col("at") + 1 + start).drop("before", "part", "at")


def update_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, status, ts. A document takes its latest status; ``ready`` also stamps
    indexed_at; error messages stay as they are."""
    last = changes.groupBy("id").agg(F.max_by("status", "ts").alias("new"), F.max_by("ts", "ts").alias("at"))
    out = documents.drop("status", "indexed_at") if "indexed_at" in documents.columns else documents
    out = documents.join(last, "id", "left")
    stamped = F.when(F.col("new") == "ready", F.col("at"))
    keep = F.col("indexed_at") if "indexed_at" in documents.columns else F.lit(None).cast("timestamp")
    return out.withColumns({"status": F.coalesce("new", "status"), "indexed_at": F.coalesce(stamped, keep)}).drop("new", "at")


def summaries_long(wide: DataFrame) -> DataFrame:
    """chunk_id, technical, business, keywords -> chunk_id, perspective, text; empties are dropped."""
    return wide.selectExpr("chunk_id", "stack(3, 'technical', technical, 'business', business, 'keywords', keywords) as (perspective, text)").where("text is not null and text <> ''")


def upsert_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INSERT OR REPLACE: of each key the row written last (``version``)."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    return both.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("i = 1").drop("i", "version")


#: child table -> (its column, parent table, parent's column)
CASCADE = {
    "document": [("folder_id", "folder", "id")],
    "sheet": [("document_id", "document", "id")],
    "chunk": [("document_id", "document", "id")],
    "chunk_summary": [("chunk_id", "chunk", "id")],
    "image": [("sheet_id", "sheet", "id")],
    "change_log": [("document_id", "document", "id")],
    "data_dict": [("document_id", "document", "id")],
    "chunk_vec": [("chunk_id", "chunk", "id")],
    "summary_vec": [("summary_id", "chunk_summary", "id")],
    "postings_chunk": [("ref_id", "chunk", "id")],
    "postings_summary": [("ref_id", "chunk_summary", "id")],
}


def cascade_delete(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Deletes the rows of ``table`` whose id is in ``gone`` and everything that hangs on them,
    vectors and postings included: a chain of anti joins on the deleted ids only."""
    out, lost = dict(tables), {table: gone.select("id")}
    out[table] = tables[table].join(gone.select("id"), "id", "left_anti")
    for child, links in CASCADE.items():
        for column, parent, _ in links:
            if child in tables and parent in lost and child != table:
                ids = lost[parent].withColumnRenamed("id", column)
                if "id" in tables[child].columns:
                    lost[child] = tables[child].join(ids, column, "left_semi").select("id")
                out[child] = tables[child].join(ids, column, "left_anti")
    return out


def cascade_keys(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """What ``cascade_delete`` takes away, as keys: for every table that loses rows a column ``key`` of ids, or of the
    ids that its rows refer to where they have none. Only key columns are read."""
    lost = {table: gone.select("id")}
    for child, links in CASCADE.items():
        for column, parent, _ in links:
            if parent in lost and child != table:
                if child in tables and "id" in tables[child].columns:
                    lost[child] = tables[child].join(lost[parent].withColumnRenamed("id", column), column, "left_semi").select("id")
                else:  # vectors and postings are keyed by their parent
                    lost[child] = lost[parent]
    return {name: ids.withColumnRenamed("id", "key").distinct() for name, ids in lost.items()}


def distinct_images(images: DataFrame) -> DataFrame:
    """One row per payload digest: content-addressed files are written once."""
    from ..functions.text import image_digest, image_format

    return images.select(image_digest(F.col("bytes")).alias("digest"), image_format(F.col("format")).alias("format"), "bytes").groupBy("digest").agg(F.min("format").alias("format"), F.first("bytes").alias("bytes"))


def chat_sessions(messages: DataFrame) -> DataFrame:
    """Per session: messages, questions, characters, the last role."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_questions"), F.sum(F.length("content")).alias("n_chars"), F.max_by("role", "position").alias("last_role"))
