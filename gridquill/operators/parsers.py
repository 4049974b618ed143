"""Sheet parsers: history, table, memo, cover, screen, generic - each a plan over the grid.

Chunks are (sheet_id, chunk_order, text, markdown, hierarchy_path, kind, jira_tags, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..storage import stored
from .cells import dump_text, row_text, with_indent
from .classify import header_rows

MEMO_LIMIT = 1200
BATCH = 20
#: Tables are worked on by so many cells a task, as partitions joined by their compressed size can be large in memory, and by blocks of rows.
TASK_CELLS, BLOCK_ROWS = 250_000, 10_000


def _ordered(key: str, value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), sep)


# history -------------------------------------------------------------------------------------


def history_entries(cells: DataFrame) -> DataFrame:
    """One entry per row with a date: log_date, description, tags (sorted), chunk text and markdown."""
    rows = cells.groupBy("sheet_id", "row").agg(row_text(" ", trim=True).alias("line")).where("line <> ''")
    rows = rows.withColumn("log_date", X.first_date(F.col("line"), X.HISTORY_DATE, "-")).where("log_date is not null")
    rows = rows.withColumn("description", X.history_description(F.col("line")))
    return rows.select(
        "sheet_id",
        (F.row_number().over(Window.partitionBy("sheet_id").orderBy("row")) - 1).alias("chunk_order"),
        "log_date",
        "description",
        X.issue_codes(F.col("description")).alias("tags"),
        F.concat_ws(" ", "log_date", "description").alias("text"),
        F.concat(F.lit("- **"), "log_date", F.lit("** — "), "description").alias("markdown"),
    )


# table ---------------------------------------------------------------------------------------


def table_headers(cells: DataFrame) -> DataFrame:
    """sheet_id, header_row, col, header: of the parser's header row (top 10)."""
    return cells.join(header_rows(cells, top=10), "sheet_id").where("row = header_row").select("sheet_id", "header_row", "col", F.col("text").alias("header"))


def _kept(cells: DataFrame) -> tuple[DataFrame, int, bool]:
    """The cells stored once, the number of tasks for them, and whether a sheet is taller than a block."""
    kept = stored(cells.select("sheet_id", "row", "col", "text", "bold", "fill_color"), "table-cells")
    n, last = kept.agg(F.count("*"), F.max("row")).first()
    return kept, max(1, -(-n // TASK_CELLS)), (last or 0) >= BLOCK_ROWS


def _block(row: str = "row") -> Column:
    return F.floor(F.col(row) / BLOCK_ROWS).alias("block")


def table_values(cells: DataFrame) -> DataFrame:
    """Long form (sheet_id, row, col, header, value): every data row by header column, blanks
    filled from above; columns without a header are dropped. Tall sheets are filled in blocks of rows, each of which
    begins with the last value above it."""
    return _values(*_kept(cells))


def _values(cells: DataFrame, tasks: int, tall: bool) -> DataFrame:
    head = stored(table_headers(cells), "table-headers")
    own = cells.join(head.select("sheet_id", "header_row").distinct(), "sheet_id").where("row > header_row").drop("header_row")
    grid = own.select("sheet_id", "row").distinct().join(head.select("sheet_id", "col", "header"), "sheet_id").repartition(tasks, "sheet_id", "row", "col")
    grid = grid.join(cells.select("sheet_id", "row", "col", "text").repartition(tasks, "sheet_id", "row", "col"), ["sheet_id", "row", "col"], "left")
    grid = grid.withColumns({"text": F.nullif("text", F.lit("")), "block": _block()}).repartition(tasks, "sheet_id", "col", "block")
    above = Window.partitionBy("sheet_id", "col", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("filled", F.last("text", True).over(above))
    carried = F.lit("")
    if tall:
        # per block the row of the last value above it, then that value
        last = own.where("text <> ''").groupBy("sheet_id", "col", _block()).agg(F.max("row").alias("last"))
        blocks = own.select("sheet_id", _block()).distinct().join(head.select("sheet_id", "col"), "sheet_id")
        before = Window.partitionBy("sheet_id", "col").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        wanted = blocks.join(last, ["sheet_id", "col", "block"], "left").withColumn("row", F.last("last", True).over(before)).where("row is not null").select("sheet_id", "col", "block", "row")
        carry = stored(own.select("sheet_id", "row", "col", F.col("text").alias("carried")).join(wanted, ["sheet_id", "row", "col"]).drop("row"), "table-carry")
        grid, carried = grid.join(carry, ["sheet_id", "col", "block"], "left"), F.coalesce("carried", F.lit(""))
    return grid.select("sheet_id", "row", "col", "header", F.coalesce("filled", carried).alias("value"))


def table_records(values: DataFrame, tasks: int = 1, tall: bool = False) -> DataFrame:
    """sheet_id, row, record_no (from 0), text ("k: v ; ..."), markdown row. A record is keyed by
    header text: of repeated headers the right-most column gives the value. Rows of only blanks
    are no records. ``tall``: records are stored and counted by block first, then numbered within blocks."""
    values = values.repartition(tasks, "sheet_id", "row") if tasks > 1 else values
    keyed = values.withColumns({"shown": F.last("value").over(Window.partitionBy("sheet_id", "row", "header").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "first": F.min("col").over(Window.partitionBy("sheet_id", "row", "header"))})
    pair = F.when((F.col("col") == F.col("first")) & (F.col("shown") != ""), F.struct("col", F.concat_ws(": ", "header", "shown").alias("kv")))
    rows = keyed.groupBy("sheet_id", "row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["kv"]), " ; ").alias("text"),
        F.concat(F.lit("| "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.replace("shown", F.lit("\n"), F.lit(" ")).alias("v")))), lambda x: x["v"]), " | "), F.lit(" |")).alias("markdown_row"),
    )
    rows = rows.where("text <> ''")
    if not tall:
        return rows.withColumn("record_no", F.row_number().over(Window.partitionBy("sheet_id").orderBy("row")) - 1)
    rows = stored(rows.withColumn("block", _block()), "table-records")
    before = Window.partitionBy("sheet_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(rows.groupBy("sheet_id", "block").agg(F.count("*").alias("n")).select("sheet_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "table-blocks")
    numbered = rows.repartition(tasks, "sheet_id", "block").withColumn("i", F.row_number().over(Window.partitionBy("sheet_id", "block").orderBy("row")) - 1)
    return numbered.join(base, ["sheet_id", "block"]).select("sheet_id", "row", "text", "markdown_row", (F.col("base") + F.col("i")).alias("record_no"))


def batch_numbers(record_no: Column, size: int = BATCH) -> Column:
    """Batches of a record: stride size - 1 (one shared record) when size > 4, else size."""
    stride = size - 1 if size > 4 else size
    own = F.floor(record_no / stride).cast("long")
    if stride == size:
        return F.array(own)
    return F.when((record_no % stride == 0) & (record_no > 0), F.array(own - 1, own)).otherwise(F.array(own))


def table_chunks(cells: DataFrame, sheets: DataFrame, size: int = BATCH) -> DataFrame:
    cells, tasks, tall = _kept(cells)
    records = table_records(_values(cells, tasks, tall), tasks, tall).withColumn("batch", F.explode(batch_numbers(F.col("record_no"), size)))
    records = records.repartition(tasks, "sheet_id", "batch")
    head = table_headers(cells).groupBy("sheet_id").agg(_ordered("col", "header", " | ").alias("headers"), F.count("*").alias("width"))
    out = records.groupBy("sheet_id", "batch").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.count("*").alias("row_count"), _ordered("row", "text", "\n").alias("text"), _ordered("row", "markdown_row", "\n").alias("body"))
    out = out.join(head, "sheet_id").join(sheets.select("sheet_id", "name"), "sheet_id")
    title = F.concat(F.lit("### "), "name", F.lit(" — 行 "), F.col("row_min").cast("string"), F.lit("–"), F.col("row_max").cast("string"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width").cast("int")), " | "), F.lit(" |"))
    return out.select("sheet_id", F.col("batch").alias("chunk_order"), "row_min", "row_max", "row_count", "text", F.concat_ws("\n", title, F.lit(""), F.concat(F.lit("| "), "headers", F.lit(" |")), rule, "body").alias("markdown"), F.col("name").alias("hierarchy_path"))


def data_dictionary(cells: DataFrame) -> DataFrame:
    """Dictionary rows of sheets with >= 2 mapped columns: five fields; the right-most column of a
    field wins; a row needs a column name in either language."""
    values = table_values(cells).withColumn("field", X.dict_field(F.col("header"))).where("field is not null")
    enough = values.groupBy("sheet_id").agg(F.countDistinct("col").alias("n")).where("n >= 2").select("sheet_id")
    names = [f for f, _ in X.DICT_FIELDS]
    pick = lambda f: F.coalesce(F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("col"))), F.lit("")).alias(f)
    rows = values.join(enough, "sheet_id", "left_semi").groupBy("sheet_id", "row").agg(*(pick(f) for f in names))
    return rows.where("column_name <> '' or column_name_en <> ''")


# memo ----------------------------------------------------------------------------------------


def memo_lines(cells: DataFrame) -> DataFrame:
    """One line per row: indent, text, bold, colours of cells (and of runs where there are any)."""
    grid = cells if "indent_level" in cells.columns else with_indent(cells)
    own = F.array("font_color") if "runs" not in grid.columns else F.concat(F.array("font_color"), F.transform(F.coalesce("runs", F.array()), lambda r: r["color"]))
    rows = grid.groupBy("sheet_id", "row").agg(row_text(" ", trim=True).alias("text"), F.min("indent_level").alias("indent"), F.bool_or("bold").alias("bold"), F.flatten(F.collect_list(own)).alias("c"))
    return rows.where("text <> ''").select("sheet_id", "row", "indent", "text", "bold", F.array_sort(F.array_distinct(F.array_compact("c"))).alias("colors"))


def memo_headers(lines: DataFrame) -> DataFrame:
    """Adds is_header: within one level of the least indent, bold or short, and the next line is
    deeper; or at the least indent and bold."""
    sheet = Window.partitionBy("sheet_id")
    out = lines.withColumns({"least": F.min("indent").over(sheet), "next": F.lead("indent").over(sheet.orderBy("row"))})
    deeper = F.coalesce(F.col("next") > F.col("indent"), F.lit(False))
    short = F.col("bold") | (F.length("text") < 40)
    return out.withColumn("is_header", ((F.col("indent") <= F.col("least") + 1) & short & deeper) | ((F.col("indent") == F.col("least")) & F.col("bold"))).drop("next")


def memo_sections(headed: DataFrame) -> DataFrame:
    """Adds section_no and the header chain (h0 at the least indent, h1 one level below it)."""
    w = Window.partitionBy("sheet_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda level: F.last(F.when(F.col("is_header") & (F.col("indent") == F.col("least") + level), F.struct("row", "text")), True).over(w)
    out = headed.withColumns({"section_no": F.sum(F.col("is_header").cast("int")).over(w), "h0": at(0), "h1": at(1)})
    out = out.withColumn("h1", F.when(F.col("h0").isNull() | (F.col("h1.row") > F.col("h0.row")), F.col("h1")))
    return out.withColumn("chain", F.array_compact(F.array("h0.text", "h1.text")))


def split_body(body: Column, limit: int = MEMO_LIMIT) -> Column:
    """Ordered array of lines -> array of arrays. A piece is closed when the next line would take
    it over ``limit`` and is not deeper than the line before; bodies within the limit stay whole."""
    total = F.aggregate(body, F.lit(0), lambda a, x: a + F.length(x["text"]))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("cur"), F.lit(0).alias("size"), F.lit(0).alias("indent"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        cut = (F.size(a["cur"]) > 0) & (a["size"] + F.length(x["text"]) > limit) & (x["indent"] <= a["indent"])
        return F.struct(
            F.when(cut, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(cut, F.array(a["i"])).otherwise(F.concat(a["cur"], F.array(a["i"]))).alias("cur"),
            (F.when(cut, 0).otherwise(a["size"]) + F.length(x["text"])).alias("size"),
            x["indent"].alias("indent"),
            (a["i"] + 1).alias("i"),
        )

    places = F.aggregate(body, start, step, lambda a: F.concat(a["done"], F.array(a["cur"])))
    pieces = F.transform(places, lambda p: F.transform(p, lambda i: F.get(body, i)))
    return F.when(total <= limit, F.array(body)).otherwise(pieces)


def memo_chunks(cells: DataFrame, sheets: DataFrame, legend: DataFrame | None = None, codes: DataFrame | None = None, limit: int = MEMO_LIMIT) -> DataFrame:
    """legend: sheet_id, color, tag; codes: sheet_id, jira_codes (fallback when no colour maps)."""
    s = memo_sections(memo_headers(memo_lines(cells)))
    line = F.when(~F.col("is_header"), F.struct("row", "indent", "text", "colors"))
    sections = s.groupBy("sheet_id", "section_no").agg(F.sort_array(F.collect_list(line)).alias("body"), F.max_by("chain", F.col("row")).alias("chain"))
    pieces = sections.select("sheet_id", "section_no", "chain", F.posexplode(split_body(F.col("body"), limit)).alias("piece", "lines"))
    pieces = pieces.where((F.size("lines") > 0) | (F.size("chain") > 0)).join(sheets.select("sheet_id", "name"), "sheet_id")
    base = F.coalesce(F.array_min(F.transform("lines", lambda x: x["indent"])), F.lit(0))
    heads = F.transform("chain", lambda h, i: F.concat(F.repeat(F.lit("#"), i + 2), F.lit(" "), h))
    rows = F.transform("lines", lambda x: F.concat(F.repeat(F.lit("  "), x["indent"] - base), F.lit("- "), x["text"]))
    joined = F.array_join(F.transform("lines", lambda x: x["text"]), " ")
    out = pieces.select(
        "sheet_id",
        (F.row_number().over(Window.partitionBy("sheet_id").orderBy("section_no", "piece")) - 1).alias("chunk_order"),
        F.when(joined != "", joined).otherwise(F.array_join("chain", " > ")).alias("text"),
        F.array_join(F.concat(heads, rows), "\n").alias("markdown"),
        F.array_join(F.concat(F.array("name"), "chain"), " > ").alias("hierarchy_path"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["colors"])))).alias("colors"),
    )
    return color_tags(out, legend, codes)


def color_tags(chunks: DataFrame, legend: DataFrame | None, codes: DataFrame | None) -> DataFrame:
    """Adds jira_tags: sorted distinct tags of the chunk's colours, else the document's codes."""
    tags = None
    if legend is not None:
        hits = chunks.select("sheet_id", "chunk_order", F.explode("colors").alias("color")).join(legend, ["sheet_id", "color"])
        tags = hits.groupBy("sheet_id", "chunk_order").agg(F.sort_array(F.collect_set("tag")).alias("own"))
    out = chunks.join(tags, ["sheet_id", "chunk_order"], "left") if tags is not None else chunks.withColumn("own", F.lit(None).cast("array<string>"))
    out = out.join(codes.select("sheet_id", "jira_codes"), "sheet_id", "left") if codes is not None else out.withColumn("jira_codes", F.lit(None).cast("array<string>"))
    return out.withColumn("jira_tags", F.coalesce("own", "jira_codes", F.array().cast("array<string>"))).drop("own", "jira_codes")


# cover ---------------------------------------------------------------------------------------


def cover_metadata(cells: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """sheet_id, jira_codes, version, title, module, customer, vendor, color_map. Codes of the cells
    join those of the vision JSON (sheet_id, payload); the first date in cell order is the version."""
    found = cells.select("sheet_id", "row", "col", F.explode(X.issue_codes(F.col("text"))).alias("code")).groupBy("sheet_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    dated = cells.withColumn("d", X.first_date(F.col("text"), X.COVER_DATE, "/")).groupBy("sheet_id").agg(F.min_by(F.col("d"), F.when(F.col("d").isNotNull(), F.struct("row", "col"))).alias("version"))
    out = cells.select("sheet_id").distinct().join(found, "sheet_id", "left").join(dated, "sheet_id", "left")
    if vision is not None:
        out = out.join(vision.select("sheet_id", X.json_or_empty(F.col("payload")).alias("v")), "sheet_id", "left")
    else:
        out = out.withColumn("v", F.parse_json(F.lit("{}")))
    out = out.withColumn("v", F.coalesce("v", F.parse_json(F.lit("{}"))))
    seen = F.coalesce(F.try_variant_get("v", "$.jira_codes", "array<string>"), F.array().cast("array<string>"))
    text = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))
    legend = F.coalesce(F.try_variant_get("v", "$.color_legend", "array<struct<color_hex:string,label:string>>"), F.array().cast("array<struct<color_hex:string,label:string>>"))
    return out.select("sheet_id", F.array_sort(F.array_union(F.coalesce("codes", F.array().cast("array<string>")), seen)).alias("jira_codes"), F.coalesce("version", F.nullif(text("version"), F.lit(""))).alias("version"), *(text(k).alias(k) for k in ("title", "module", "customer", "vendor")), F.transform(legend, lambda x: F.struct(F.upper(x["color_hex"]).alias("color"), x["label"].alias("tag"))).alias("color_map"))


def cover_codes(cells: DataFrame) -> DataFrame:
    """sheet_id, code, place: distinct codes in the order in which cells first hold them."""
    each = cells.select("sheet_id", "row", "col", F.posexplode(F.regexp_extract_all("text", F.lit(X.ISSUE_CODE), F.lit(1))).alias("p", "code"))
    first = each.groupBy("sheet_id", "code").agg(F.min(F.struct("row", "col", "p")).alias("at"))
    return first.select("sheet_id", "code", (F.row_number().over(Window.partitionBy("sheet_id").orderBy("at", "code")) - 1).alias("place"))


def merged_metadata(covers: DataFrame, key: str, order: str) -> DataFrame:
    """One row per document; of several covers the last one's non-empty values win."""
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col(order))).alias(c)
    return covers.groupBy(key).agg(*(last(c) for c in ("title", "module", "customer", "vendor", "version")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("jira_codes")))).alias("jira_codes"))


# screen and generic --------------------------------------------------------------------------


def screen_chunks(sheets: DataFrame, cells: DataFrame, images: DataFrame) -> DataFrame:
    """One chunk per image (image_index, anchor_cell, description), or one of the text alone."""
    side = dump_text(cells, " ").select("sheet_id", F.col("raw_text").alias("side"))
    x = sheets.select("sheet_id", "name").join(side, "sheet_id", "left").join(images.select("sheet_id", "image_index", "anchor_cell", "description"), "sheet_id", "left")
    side_text, seen = F.coalesce("side", F.lit("")), F.coalesce("description", F.lit(""))
    has = F.col("image_index").isNotNull()
    md = F.when(has, F.concat(F.lit("### "), "name", F.lit("\n\n"), seen, F.lit("\n\n---\n\n**画面周围文字**:\n\n"), side_text)).otherwise(F.concat(F.lit("### "), "name", F.lit("\n\n"), side_text))
    out = x.where(has | (F.trim(side_text) != ""))
    return out.select("sheet_id", F.coalesce("image_index", F.lit(0)).alias("chunk_order"), F.when(has, F.trim(F.concat_ws(" ", F.nullif(seen, F.lit("")), F.nullif(side_text, F.lit(""))))).otherwise(side_text).alias("text"), md.alias("markdown"), F.when(has, "screen").otherwise("screen_text_only").alias("kind"), F.col("name").alias("hierarchy_path"))


def generic_chunks(sheets: DataFrame, cells: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """Vision sections (sheet_id, payload with sections[title, content]) and a raw-text chunk."""
    dump = dump_text(cells, " ").join(sheets.select("sheet_id", "name"), "sheet_id").where("trim(raw_text) <> ''")
    empty = sheets.select("sheet_id", "name").where(F.lit(False)).withColumns({"title": F.lit(""), "content": F.lit(""), "p": F.lit(0)})
    secs = empty
    if vision is not None:
        v = vision.select("sheet_id", X.json_or_empty(F.col("payload")).alias("v")).join(sheets.select("sheet_id", "name"), "sheet_id")
        items = v.select("sheet_id", "name", F.posexplode(F.try_variant_get("v", "$.sections", "array<variant>")).alias("p", "s"))
        is_object = F.try_variant_get("s", "$", "map<string,variant>").isNotNull()
        content = F.coalesce(F.when(is_object, F.try_variant_get("s", "$.content", "string")).otherwise(F.try_variant_get("s", "$", "string")), F.lit(""))
        title = F.coalesce(F.nullif(F.try_variant_get("s", "$.title", "string"), F.lit("")), F.concat(F.col("name"), F.lit(" 区块 "), (F.col("p") + 1).cast("string")))
        secs = items.select("sheet_id", "name", title.alias("title"), content.alias("content"), "p").where("content <> ''")
    secs = secs.withColumn("chunk_order", F.row_number().over(Window.partitionBy("sheet_id").orderBy("p")) - 1)
    own = secs.select("sheet_id", "chunk_order", F.concat_ws(" ", "title", "content").alias("text"), F.concat(F.lit("### "), "name", F.lit(" — "), "title", F.lit("\n\n"), "content").alias("markdown"), F.lit("generic_section").alias("kind"), F.concat_ws(" > ", "name", "title").alias("hierarchy_path"))
    count = secs.groupBy("sheet_id").agg(F.count("*").cast("int").alias("n"))
    raw = dump.join(count, "sheet_id", "left").select("sheet_id", F.coalesce("n", F.lit(0)).alias("chunk_order"), F.col("raw_text").alias("text"), F.concat(F.lit("### "), "name", F.lit(" (raw)\n\n```\n"), "raw_text", F.lit("\n```")).alias("markdown"), F.lit("generic_raw").alias("kind"), F.col("name").alias("hierarchy_path"))
    return own.unionByName(raw)


def document_context(sheets: DataFrame, cells: DataFrame, classified: DataFrame, vision: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the cover sheets of a document tell its other sheets: (sheet_id, color, tag), (sheet_id,
    jira_codes) and the merged metadata, a row per document. Of several covers the last one's tag for a colour
    wins. ``sheets`` without document_id are documents of their own."""
    place = sheets.select("sheet_id", (F.col("document_id") if "document_id" in sheets.columns else F.col("sheet_id")).alias("document_id"), (F.col("sheet_index") if "sheet_index" in sheets.columns else F.lit(0)).alias("sheet_index"))
    own = cells.join(classified.where("sheet_type = 'cover'"), "sheet_id", "left_semi")
    covers = cover_metadata(own, vision).join(place, "sheet_id")
    legend = covers.select("document_id", "sheet_index", F.posexplode("color_map").alias("i", "c"))
    legend = legend.groupBy("document_id", F.col("c.color").alias("color")).agg(F.max_by("c.tag", F.struct("sheet_index", "i")).alias("tag"))
    meta = merged_metadata(covers, "document_id", "sheet_index")
    return place.join(legend, "document_id").select("sheet_id", "color", "tag"), place.join(meta, "document_id").select("sheet_id", "jira_codes"), meta


def dispatch(sheets: DataFrame, cells: DataFrame, classified: DataFrame, images: DataFrame | None = None, vision: DataFrame | None = None, context: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Chunks of every sheet by its type, in two passes: the covers of a document give their colour tags
    and codes (``context``, by default those of ``document_context``) to its other sheets. Index sheets use
    the table parser, whatever is left the generic one; a screen sheet without images gives its text. Image
    descriptions are JSON, rendered as text."""
    kind = stored(classified.select("sheet_id", "sheet_type").distinct(), "sheet-types")
    # the cells once, a folder per type, so that each parser reads its own
    placed = stored(cells.join(kind, "sheet_id"), "cells-by-type", "sheet_type")
    pick = lambda *t: placed.where(F.col("sheet_type").isin(*t)).drop("sheet_type")
    of = lambda *t: sheets.join(kind.where(F.col("sheet_type").isin(*t)), "sheet_id", "left_semi")
    cols = ["sheet_id", "chunk_order", "text", "markdown", "hierarchy_path"]
    none = F.array().cast("array<string>")
    part = lambda df, k, e: df.select(*(F.col(c).cast("long") if c == "chunk_order" else F.col(c) for c in cols), F.lit(k).alias("kind"), F.lit(e).alias("enrich_eligible"), (F.col("jira_tags") if "jira_tags" in df.columns else none).alias("jira_tags"))
    legend, codes, _ = context or document_context(sheets, pick("cover"), kind, vision)
    if images is None:
        images = sheets.select("sheet_id").where("false").withColumns({"image_index": F.lit(0), "anchor_cell": F.lit(""), "description": F.lit("")})
    described = images.withColumn("description", F.when(F.col("description").isNotNull(), X.render_description(X.json_or_empty(F.col("description")))))
    out = [
        part(history_entries(pick("history")).withColumn("hierarchy_path", F.lit("変更履歴")), "change_log", False),
        part(table_chunks(pick("table", "index"), sheets), "table_batch", False),
        part(memo_chunks(pick("memo"), sheets, legend, codes), "memo_section", True),
        part(generic_chunks(of("unknown"), pick("unknown"), vision), "generic", True),
        part(screen_chunks(of("screen"), pick("screen"), described), "screen", True),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
