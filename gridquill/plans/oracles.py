"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

# Shared table expressions, by name -----------------------------------------------------------

TEXTS = {
    "docs": "SELECT d.doc_id id, TRY_CAST(substring(d.source, 4) AS BIGINT) folder_id, 'doc_' || d.doc_id filename, d.n_chars file_size, '{\"quality\":' || l.quality || ',\"toxic\":' || l.toxic || '}' doc_metadata FROM documents d LEFT JOIN labels l USING (doc_id)",
    "folders": "SELECT DISTINCT TRY_CAST(substring(source, 4) AS BIGINT) id, source AS name FROM documents",
    "lines": "SELECT doc_id, unnest(range(1, len(l) + 1)) line_no, unnest(l) line FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)",
    "chunks": "SELECT l.doc_id * 1000 + l.line_no id, l.doc_id document_id, d.folder_id, l.line AS text, l.line_no chunk_order FROM lines l JOIN docs d ON d.id = l.doc_id WHERE trim(l.line) <> ''",
    "summaries": "SELECT vec_id id, vec_id % 100 chunk_id, ['technical', 'business', 'keywords'][vec_id % 3 + 1] perspective, embedding FROM embeddings",
    "cells": "SELECT doc_id sheet_id, line_no AS row, p + length(line) % 3 AS col, text, regexp_matches(line, '^[A-Z]') bold, CASE length(line) % 5 WHEN 0 THEN '#FF0000' WHEN 1 THEN '#0000FF' END font_color FROM (SELECT doc_id, line_no, line, unnest(range(1, len(s) + 1)) p, unnest(s) AS text FROM (SELECT *, string_split(line, ' | ') s FROM lines)) WHERE trim(text) <> ''",
    "grid": "SELECT *, dense_rank() OVER (PARTITION BY sheet_id ORDER BY leftmost) - 1 indent_level FROM (SELECT *, min(col) OVER (PARTITION BY sheet_id, row) leftmost FROM cells)",
    "sheets": "SELECT doc_id sheet_id, 'sheet ' || source AS name FROM documents",
    "parts": "SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) sheet_id, row_number() OVER w + 1 AS row, p_brand, p_name, CASE WHEN p_type = lag(p_type) OVER w THEN '' ELSE p_type END t, CAST(p_size AS VARCHAR) s, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)",
    "part_values": "SELECT sheet_id, row, unnest([1, 2, 3, 4, 5]) AS col, unnest(['p_brand', 'p_name', 'p_type', 'p_size', 'p_retailprice']) AS header, unnest([p_brand, p_name, coalesce(last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY sheet_id ORDER BY row), ''), s, r]) AS value FROM parts",
    "orders_n": "SELECT o_custkey sheet_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row, year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m-%d') iso, o_orderpriority p, count(*) OVER (PARTITION BY o_custkey) n FROM orders",
    "memo": "SELECT *, lead(indent) OVER (PARTITION BY sheet_id ORDER BY row) nxt, min(indent) OVER (PARTITION BY sheet_id) least FROM (SELECT sheet_id, row, trim(string_agg(text, ' ' ORDER BY col)) AS text, min(indent_level) indent, bool_or(bold) bold, list_sort(list_distinct(list(font_color) FILTER (font_color IS NOT NULL))) colors FROM grid GROUP BY sheet_id, row) WHERE text <> ''",
    "headed": "SELECT *, (indent <= least + 1 AND (bold OR length(text) < 40) AND coalesce(nxt > indent, false)) OR (indent = least AND bold) AS is_header FROM memo",
    "tok": "SELECT doc_id, unnest(range(len(t))) pos, unnest(t) term FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') t FROM documents)",
    "q": "SELECT b.item_id query_id, list_filter(string_split_regex(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:3] t, CAST(e.embedding AS DOUBLE[]) e FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id",
    "vec": "SELECT vec_id id, CAST(embedding AS DOUBLE[]) e FROM embeddings",
    "sims": "SELECT q.query_id, v.id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) score FROM vec v, q",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sims) WHERE rank < 30",
    "vc": "SELECT query_id, id chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM near SEMI JOIN documents ON doc_id = id",
    "vs": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM (SELECT query_id, id % 100 chunk_id, max(score) score FROM near GROUP BY ALL)",
    "stats": "SELECT count(*) n_rows, avg(dl) avg_len FROM (SELECT doc_id, count(*) dl FROM tok GROUP BY doc_id)",
    "qt": "SELECT query_id, unnest(range(len(t))) i, unnest(t) term, len(t) need FROM q",
    "hit": "SELECT qt.query_id, qt.i, qt.need, tok.doc_id, count(*) tf FROM qt JOIN tok USING (term) GROUP BY ALL",
    "bm": "SELECT query_id, doc_id chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) score FROM (SELECT h.*, l.dl, s.avg_len, CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END idf FROM hit h JOIN (SELECT query_id, i, count(*) df FROM hit GROUP BY ALL) USING (query_id, i) JOIN (SELECT doc_id, count(*) dl FROM tok GROUP BY ALL) l ON l.doc_id = h.doc_id, stats s) GROUP BY query_id, doc_id HAVING count(*) = any_value(need)",
    "fts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM bm) WHERE rank < 30",
    "ranked": "SELECT query_id, chunk_id, rank, 0 src FROM (SELECT v.* FROM vc v) UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1, 1 FROM vs SEMI JOIN documents ON doc_id = chunk_id UNION ALL SELECT query_id, chunk_id, rank, 2 FROM fts",
    "fused": "SELECT * FROM (SELECT query_id, chunk_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, chunk_id) - 1 AS rank FROM (SELECT query_id, chunk_id, coalesce(max(CASE WHEN src = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN src = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN src = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) score, min(src * 1000 + rank) tie, string_agg(['vec_chunk', 'vec_summary', 'fts'][src + 1], ',' ORDER BY src) sources FROM ranked GROUP BY ALL)) WHERE rank < 30",
    "found": "SELECT f.query_id, f.chunk_id, f.sources, f.rank rrf_rank, q.t qterms, d.text, d.source, list_distinct(q.t) u, list_filter(string_split_regex(lower(d.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w FROM fused f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf_rank) - 1 AS rank FROM (SELECT *, CAST(len(list_filter(u, lambda x: list_contains(w, x))) AS DOUBLE) / len(u) score FROM found)) WHERE rank < 5",
}
NEEDS = {
    "chunks": ["docs", "lines"], "cells": ["lines"], "grid": ["cells"], "part_values": ["parts"], "memo": ["grid"], "headed": ["memo"],
    "sims": ["vec", "q"], "near": ["sims"], "vc": ["near"], "vs": ["near"], "stats": ["tok"], "qt": ["q"], "hit": ["qt", "tok"], "bm": ["hit", "stats"], "fts": ["bm"],
    "ranked": ["vc", "vs", "fts"], "fused": ["ranked"], "found": ["fused"], "best": ["found"],
}


def _with(names: list[str], body: str, **more: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, ()):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({TEXTS[n]})" for n in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


_CLASS = """SELECT sheet_id, CASE WHEN n_cells <= 6 AND n_rows <= 6 THEN 'cover' WHEN n_rows > 0 AND date_rows * 2 >= n_rows AND n_rows <= 50 THEN 'history'
  WHEN n_rows >= 4 AND body_rows >= 3 AND alike_rows * 10 >= body_rows * 6 THEN 'table'
  WHEN (n_indents >= 3)::INT + (n_colors >= 2)::INT + (n_rows >= 15)::INT >= 2 THEN 'memo' ELSE 'unknown' END sheet_type FROM feat"""
_CONF = "SELECT sheet_id, sheet_type, CASE sheet_type WHEN 'cover' THEN 0.7 WHEN 'history' THEN 0.75 WHEN 'table' THEN 0.78 WHEN 'memo' THEN 0.65 ELSE 0.0 END::DOUBLE confidence FROM cls"
_FEAT = {
    "rws": "SELECT sheet_id, row, count(*) n, arg_min(text, col) first, min(indent_level) indent, bool_or(bold) marked, row_number() OVER (PARTITION BY sheet_id ORDER BY row) i FROM grid GROUP BY sheet_id, row",
    "hd": "SELECT sheet_id, coalesce(min(CASE WHEN n >= 3 AND marked AND i <= 8 THEN row END), min(CASE WHEN n >= 3 THEN row END)) h FROM rws GROUP BY sheet_id",
    "hc": "SELECT g.sheet_id, g.col, count(*) OVER (PARTITION BY g.sheet_id) width FROM grid g JOIN hd ON hd.sheet_id = g.sheet_id AND g.row = hd.h",
    "sh": "SELECT g.sheet_id, g.row, count(hc.col) shared FROM grid g JOIN hd ON hd.sheet_id = g.sheet_id AND g.row > hd.h LEFT JOIN hc ON hc.sheet_id = g.sheet_id AND hc.col = g.col GROUP BY ALL",
    "tb": "SELECT s.sheet_id, count(*) body_rows, sum(CASE WHEN shared >= greatest(2, width - 1) THEN 1 ELSE 0 END)::BIGINT alike_rows FROM sh s JOIN (SELECT DISTINCT sheet_id, width FROM hc) USING (sheet_id) GROUP BY s.sheet_id",
    "ba": "SELECT sheet_id, sum(n)::BIGINT n_cells, count(*) n_rows, sum(CASE WHEN regexp_matches(first, '[0-9]{4}[/-][0-9]{1,2}') THEN 1 ELSE 0 END)::BIGINT date_rows, count(DISTINCT indent) n_indents FROM rws GROUP BY sheet_id",
    "co": "SELECT sheet_id, count(DISTINCT font_color) n_colors FROM grid GROUP BY sheet_id",
    "feat": "SELECT k.sheet_id, coalesce(n_cells, 0) n_cells, coalesce(n_rows, 0) n_rows, coalesce(date_rows, 0) date_rows, coalesce(n_indents, 0) n_indents, coalesce(n_colors, 0) n_colors, coalesce(body_rows, 0) body_rows, coalesce(alike_rows, 0) alike_rows FROM keys k LEFT JOIN ba USING (sheet_id) LEFT JOIN co USING (sheet_id) LEFT JOIN tb USING (sheet_id)",
}
_PROSE = {"keys": "SELECT doc_id sheet_id FROM documents"} | _FEAT
_GRID = "SELECT *, dense_rank() OVER (PARTITION BY sheet_id ORDER BY leftmost) - 1 indent_level FROM (SELECT *, min(col) OVER (PARTITION BY sheet_id, row) leftmost FROM c)"
_PART_GRID = "SELECT *, NULL::VARCHAR font_color FROM (SELECT sheet_id, row, unnest([1, 2, 3, 4, 5]) AS col, unnest([p_brand, p_name, t, s, r]) AS text, false AS bold FROM parts UNION ALL SELECT sheet_id, 1, unnest([1, 2, 3, 4, 5]), unnest(['p_brand', 'p_name', 'p_type', 'p_size', 'p_retailprice']), true FROM (SELECT DISTINCT sheet_id FROM parts)) WHERE text <> ''"
_ORDER_GRID = "SELECT sheet_id, row, unnest([1, 2]) AS col, unnest([d, p]) AS text, false AS bold, NULL::VARCHAR font_color FROM orders_n"
_SHEETS = {"keys": "SELECT DISTINCT sheet_id FROM grid"} | _FEAT
_TABLES = "SELECT 'folder' table_name, count(*) n_rows FROM f UNION ALL SELECT 'document', count(*) FROM dd UNION ALL SELECT 'chunk', count(*) FROM dd UNION ALL SELECT 'change_log', count(*) FROM dd UNION ALL SELECT 'chunk_summary', count(*) FROM embeddings WHERE vec_id % 100 NOT IN (SELECT id FROM gone) UNION ALL SELECT 'summary_vec', count(*) FROM embeddings WHERE vec_id % 100 NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunk_vec', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)"
_RANKED = "round(score, 6) score, rank"

ORACLES: dict[str, str] = {
    "folder_listing": _with(["folders", "docs", "chunks"], "SELECT f.id, f.name, (SELECT count(*) FROM docs d WHERE d.folder_id = f.id) n_documents, (SELECT count(*) FROM chunks c WHERE c.folder_id = f.id) n_chunks FROM folders f"),
    "document_listing": _with(["chunks"], "SELECT d.id, d.folder_id, d.filename, d.file_size, coalesce(d.doc_metadata, '{}') doc_metadata, coalesce(c.n, 0) n_chunks FROM docs d LEFT JOIN (SELECT document_id, count(*) n FROM chunks GROUP BY ALL) c ON c.document_id = d.id"),
    "document_listing_folder": _with(["chunks"], "SELECT d.id, d.filename, coalesce(c.n, 0) n_chunks FROM docs d LEFT JOIN (SELECT document_id, count(*) n FROM chunks GROUP BY ALL) c ON c.document_id = d.id WHERE d.folder_id = 3"),
    "document_detail": _with(["folders", "docs"], "SELECT f.id, f.name, coalesce(string_agg(d.filename, ',' ORDER BY d.filename), '') files FROM folders f LEFT JOIN docs d ON d.folder_id = f.id GROUP BY f.id, f.name"),
    "chunk_listing": _with(["chunks", "sheets"], "SELECT c.id, s.name sheet_name, c.chunk_order, c.text FROM chunks c JOIN sheets s ON s.sheet_id = c.document_id WHERE c.document_id = 7"),
    "document_sheets": "SELECT o_orderkey id, 'order_' || o_orderkey filename, count(l_orderkey) n_sheets, coalesce(string_agg(l_linenumber || ':' || l_linestatus || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_linestatus, l_returnflag), '') sheets FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "chunk_detail_with_summaries": _with(["summaries"], "SELECT d.doc_id chunk_id, coalesce(string_agg(s.perspective || ':' || s.id, ',' ORDER BY s.perspective, s.id), '') summaries FROM documents d LEFT JOIN summaries s ON s.chunk_id = d.doc_id GROUP BY d.doc_id"),
    "scope_filter": _with(["chunks"], "SELECT id, document_id, folder_id FROM chunks WHERE folder_id = 3 AND document_id = 23"),
    "scope_modes": _with(["docs"], "SELECT id, CASE WHEN id % 3 = 2 THEN 'doc:' || id WHEN id % 3 > 0 THEN 'folder:' || folder_id ELSE 'all' END AS mode FROM docs"),
    "cascade_delete_document": _with(["docs", "folders"], _TABLES, gone="SELECT id FROM docs WHERE id % 10 = 0", dd="SELECT id FROM docs WHERE id % 10 <> 0", f="SELECT * FROM folders"),
    "cascade_delete_folder": _with(["docs", "folders"], _TABLES, gone="SELECT id FROM docs WHERE folder_id IN (0, 1)", dd="SELECT id FROM docs WHERE folder_id NOT IN (0, 1)", f="SELECT * FROM folders WHERE id NOT IN (0, 1)"),
    "vector_upsert_latest": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0",
    "status_update": "WITH c AS (SELECT user_id % 50 id, arg_max(event_type, (ts, event_id)) e FROM events GROUP BY ALL) SELECT d.doc_id id, CASE WHEN e IS NULL THEN 'parsing' WHEN e = 'click' THEN 'ready' ELSE 'failed' END status, coalesce(e = 'click', false) indexed FROM documents d LEFT JOIN c ON c.id = d.doc_id",
    "insert_ids": _with(["chunks"], "SELECT document_id, chunk_order, row_number() OVER (ORDER BY document_id, chunk_order) id FROM chunks"),
    "summaries_unpivot": "SELECT * FROM (SELECT n_nationkey chunk_id, unnest(['technical', 'business', 'keywords']) perspective, unnest([n_name, CASE WHEN n_regionkey > 0 THEN lower(n_name) END, CASE WHEN n_regionkey > 1 THEN 'k' ELSE '' END]) AS text FROM nation) WHERE text IS NOT NULL AND text <> ''",
    "image_dedupe": "SELECT DISTINCT substring(sha1(text), 1, 12) digest, 'png' AS format FROM documents",
    "chat_sessions": "SELECT conv_id session_id, count(*) n_messages, count(*) FILTER (role = 'user') n_questions, sum(length(text))::BIGINT n_chars, arg_max(role, turn) last_role FROM conversations GROUP BY conv_id",
    "cells_indent_ladder": _with(["grid"], "SELECT sheet_id, row, col, indent_level FROM grid"),
    "cells_max_guard": _with(["cells"], "SELECT c.sheet_id, count(*) n_cells, max(c.row) last_row FROM cells c JOIN k USING (sheet_id, row) WHERE coalesce(k.before, 0) < 12 GROUP BY c.sheet_id", k="SELECT sheet_id, row, sum(n) OVER (PARTITION BY sheet_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT sheet_id, row, count(*) n FROM cells GROUP BY ALL)"),
    "workbook_sheets": "SELECT n_regionkey::BIGINT region, 0::BIGINT sheet_index, 'nations' AS name, count(*) max_row, 3::BIGINT max_col, true has_images, 'C1:D1' merged FROM nation GROUP BY 1",
    "workbook_cells": """WITH n AS (SELECT n_regionkey::BIGINT region, n_nationkey k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row FROM nation),
l AS (SELECT *, CASE WHEN k % 2 = 1 THEN 1 ELSE 2 END c, (k % 2 = 0 AND bool_or(k % 2 = 1) OVER (PARTITION BY region))::BIGINT indent_level FROM n)
SELECT region, row, c::BIGINT col, CASE c WHEN 1 THEN 'A' ELSE 'B' END col_letter, k::VARCHAR AS text, indent_level, false is_merge_anchor, '' merged_range FROM l
UNION ALL SELECT region, row, 3, 'C', trim(n_name), indent_level, row = 1, CASE WHEN row = 1 THEN 'C1:D1' ELSE '' END FROM l""",
    "workbook_images": "SELECT DISTINCT n_regionkey::BIGINT region, 0::BIGINT image_index, 'B5' anchor_cell, 'png' AS format, 'picture ' || n_regionkey payload FROM nation",
    "cells_merged": _with(["cells"], "SELECT sheet_id, row, col, CASE WHEN row = 1 AND col = 2 THEN 'B1:C1' END merged_range, row = 1 AND col = 2 AS is_merge_anchor FROM cells"),
    "sheet_dump_text": _with(["cells"], "SELECT sheet_id, string_agg(l, chr(10) ORDER BY row) raw_text FROM (SELECT sheet_id, row, string_agg(text, chr(9) ORDER BY col) l FROM cells GROUP BY ALL) GROUP BY sheet_id"),
    "sheet_dump_markdown": _with(
        ["grid", "sheets"],
        "SELECT s.sheet_id, '# Sheet: ' || s.name || coalesce(chr(10) || b.t, '') || coalesce(CASE WHEN b.n > 5 THEN chr(10) || '... (' || (b.n - 5) || ' more rows omitted)' ELSE '' END, '') markdown FROM sheets s LEFT JOIN b USING (sheet_id)",
        r="SELECT sheet_id, row, repeat('  ', arg_min(indent_level, col)) || '- ' || string_agg(text, ' | ' ORDER BY col) l, row_number() OVER (PARTITION BY sheet_id ORDER BY row) i, count(*) OVER (PARTITION BY sheet_id) n FROM grid GROUP BY sheet_id, row",
        b="SELECT sheet_id, string_agg(l, chr(10) ORDER BY row) t, max(n) n FROM r WHERE i <= 5 GROUP BY sheet_id",
    ),
    "sheet_inspect": _with(["grid"], "SELECT sheet_id, count(*) n_cells, count(DISTINCT row) n_rows, coalesce(string_agg(DISTINCT font_color, ',' ORDER BY font_color), '') colors, '' fills, array_to_string(list_sort(list_distinct(list(indent_level))), ',') indents FROM grid GROUP BY sheet_id"),
    "classify_features": _with(["grid"], "SELECT * FROM feat", **_PROSE),
    "classify_sheets": _with(["grid"], _CONF, **_PROSE, cls=_CLASS),
    "screenshot_need": _with(["grid"], "SELECT sheet_id, sheet_type IN ('cover', 'screen', 'unknown') need_screenshot FROM cls", **_PROSE, cls=_CLASS),
    "classify_table_sheets": _with(["parts"], _CONF, c=_PART_GRID, grid=_GRID, **_SHEETS, cls=_CLASS),
    "classify_history_sheets": _with(["orders_n"], _CONF, c=_ORDER_GRID, grid=_GRID, **_SHEETS, cls=_CLASS),
    "name_hint": "SELECT n_nationkey::BIGINT id, ['表紙', '更新履歴', '画面一覧', 'guide', 'data_dict', 'note', 'Sheet1'][n_nationkey % 7 + 1] || ' ' || substring(n_name, 1, 2) AS name, ['cover', 'history', 'index', 'screen', 'table', 'memo', ''][n_nationkey % 7 + 1] hint FROM nation",
    "history_entries": _with(["orders_n"], "SELECT sheet_id, row - 1 chunk_order, iso log_date, p description, iso || ' ' || p AS text, '- **' || iso || '** — ' || p markdown FROM orders_n"),
    "table_header": _with(["parts"], "SELECT sheet_id, 1::BIGINT header_row, unnest([1, 2, 3, 4, 5])::BIGINT AS col, unnest(['p_brand', 'p_name', 'p_type', 'p_size', 'p_retailprice']) AS header FROM (SELECT DISTINCT sheet_id FROM parts)"),
    "table_forward_fill": _with(["part_values"], "SELECT sheet_id, row, col::BIGINT AS col, header, value FROM part_values"),
    "table_batches": _with(
        ["part_values"],
        "SELECT sheet_id, b chunk_order, min(row) row_min, max(row) row_max, count(*) row_count, (sum(length(t)) + count(*) - 1)::BIGINT n_text, (length('### parts — 行 ' || min(row) || '–' || max(row)) + 2 + length('| p_brand | p_name | p_type | p_size | p_retailprice |') + 1 + length('| --- | --- | --- | --- | --- |') + 1 + sum(length(m)) + count(*) - 1)::BIGINT n_markdown FROM (SELECT *, unnest(CASE WHEN r % 19 = 0 AND r > 0 THEN [r // 19 - 1, r // 19] ELSE [r // 19] END) b FROM rec) GROUP BY sheet_id, b",
        rec="SELECT sheet_id, row, string_agg(header || ': ' || value, ' ; ' ORDER BY col) FILTER (value <> '') t, '| ' || string_agg(value, ' | ' ORDER BY col) || ' |' m, row_number() OVER (PARTITION BY sheet_id ORDER BY row) - 1 r FROM part_values GROUP BY sheet_id, row",
    ),
    "data_dict_rows": "SELECT 1::BIGINT sheet_id, (n_nationkey + 2)::BIGINT AS row, r_name table_name, '' table_name_en, n_name column_name, coalesce(last_value(CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END IGNORE NULLS) OVER (ORDER BY n_nationkey), '') column_name_en, 'd' description FROM nation JOIN region ON r_regionkey = n_regionkey",
    "memo_headers": _with(["headed"], "SELECT sheet_id, row, indent, is_header FROM headed"),
    "memo_sections": _with(
        ["headed"],
        "SELECT sheet_id, row, section_no, array_to_string(list_filter([h0.t, CASE WHEN h0 IS NULL OR h1.r > h0.r THEN h1.t END], lambda x: x IS NOT NULL), ' > ') path FROM z",
        z="SELECT sheet_id, row, (sum(is_header::INT) OVER w)::BIGINT section_no, last_value(CASE WHEN is_header AND indent = least THEN {'r': row, 't': text} END IGNORE NULLS) OVER w h0, last_value(CASE WHEN is_header AND indent = least + 1 THEN {'r': row, 't': text} END IGNORE NULLS) OVER w h1 FROM headed WINDOW w AS (PARTITION BY sheet_id ORDER BY row)",
    ),
    # a section's lines are folded into pieces one line a step, by a recursive table; its limit is the parser's
    "memo_split": _with(
        ["headed", "sheets"],
        """SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY section_no, piece) - 1 chunk_order, CASE WHEN coalesce(t, '') <> '' THEN t ELSE array_to_string(chain, ' > ') END AS text,
  concat_ws(chr(10), CASE WHEN len(chain) > 0 THEN array_to_string(list_transform(chain, lambda h, i: repeat('#', i + 1) || ' ' || h), chr(10)) END, m) markdown, array_to_string(list_concat([name], chain), ' > ') hierarchy_path
  FROM pieces JOIN sheets USING (sheet_id) WHERE t IS NOT NULL OR len(chain) > 0""",
        z="SELECT *, (sum(is_header::INT) OVER w)::BIGINT section_no, last_value(CASE WHEN is_header AND indent = least THEN {'r': row, 't': text} END IGNORE NULLS) OVER w h0, last_value(CASE WHEN is_header AND indent = least + 1 THEN {'r': row, 't': text} END IGNORE NULLS) OVER w h1 FROM headed WINDOW w AS (PARTITION BY sheet_id ORDER BY row)",
        placed="SELECT sheet_id, section_no, row, text, indent, is_header, list_filter([h0.t, CASE WHEN h0 IS NULL OR h1.r > h0.r THEN h1.t END], lambda x: x IS NOT NULL) chain FROM z",
        chains="SELECT sheet_id, section_no, arg_max(chain, row) chain FROM placed GROUP BY ALL",
        memo_body="SELECT sheet_id, section_no, row, text, indent, row_number() OVER w k, sum(length(text)) OVER (PARTITION BY sheet_id, section_no) total FROM placed WHERE NOT is_header WINDOW w AS (PARTITION BY sheet_id, section_no ORDER BY row)",
        fold="SELECT sheet_id, section_no, row, text, indent, k, length(text)::BIGINT size, 0 piece FROM memo_body WHERE k = 1 UNION ALL SELECT sheet_id, section_no, row, text, indent, k, CASE WHEN cut THEN 0 ELSE size END + length(text), piece + cut::INT FROM (SELECT b.*, f.size, f.piece, b.total > 1200 AND f.size + length(b.text) > 1200 AND b.indent <= f.indent cut FROM fold f JOIN memo_body b ON b.sheet_id = f.sheet_id AND b.section_no = f.section_no AND b.k = f.k + 1)",
        cuts="SELECT sheet_id, section_no, piece, string_agg(text, ' ' ORDER BY row) t, string_agg(repeat('  ', (indent - least_indent)::BIGINT) || '- ' || text, chr(10) ORDER BY row) m FROM (SELECT *, min(indent) OVER (PARTITION BY sheet_id, section_no, piece) least_indent FROM fold) GROUP BY ALL",
        pieces="SELECT c.sheet_id, c.section_no, c.chain, coalesce(p.piece, 0) piece, p.t, p.m FROM chains c LEFT JOIN cuts p ON p.sheet_id = c.sheet_id AND p.section_no = c.section_no",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("memo_body AS (", "memo_body AS MATERIALIZED (", 1),
    "color_tags": _with(["memo"], "SELECT sheet_id, row, coalesce(array_to_string(colors, ','), '') colors, CASE WHEN sheet_id % 2 = 0 AND list_contains(colors, '#FF0000') THEN 'DBL-179' ELSE 'DBL-10' END tags FROM memo"),
    "cover_codes": "WITH c AS (SELECT s_suppkey % 10 sheet_id, s_suppkey // 10 AS row, 'SUPP-' || (s_suppkey % 7) a, 'AB-' || s_nationkey b FROM supplier), e AS (SELECT sheet_id, a code, row * 2 AS p FROM c UNION ALL SELECT sheet_id, b, row * 2 + 1 FROM c) SELECT sheet_id, code, row_number() OVER (PARTITION BY sheet_id ORDER BY min(p)) - 1 place FROM e GROUP BY sheet_id, code",
    "cover_metadata": "SELECT sheet_id, string_agg(DISTINCT code, ',' ORDER BY code) codes, arg_min('2021/03/' || lpad((n + 1)::VARCHAR, 2, '0'), row) AS version FROM (SELECT s_suppkey % 10 sheet_id, s_suppkey // 10 AS row, s_nationkey n, unnest(['SUPP-' || (s_suppkey % 7), 'AB-' || s_nationkey]) code FROM supplier) GROUP BY sheet_id",
    "screen_chunks": _with(["cells", "sheets"], "SELECT s.sheet_id, 0::BIGINT chunk_order, CASE WHEN s.sheet_id % 4 = 0 THEN trim('a picture ' || coalesce(r.t, '')) ELSE r.t END AS text, CASE WHEN s.sheet_id % 4 = 0 THEN 'screen' ELSE 'screen_text_only' END kind FROM sheets s LEFT JOIN r USING (sheet_id) WHERE s.sheet_id % 4 = 0 OR trim(coalesce(r.t, '')) <> ''", r="SELECT sheet_id, string_agg(l, chr(10) ORDER BY row) t FROM (SELECT sheet_id, row, string_agg(text, ' ' ORDER BY col) l FROM cells GROUP BY ALL) GROUP BY sheet_id"),
    "generic_chunks": _with(
        ["cells", "sheets"],
        "SELECT sheet_id, CASE WHEN sheet_id % 5 = 0 THEN 2 ELSE 0 END::BIGINT chunk_order, t AS text, 'generic_raw' kind, name hierarchy_path FROM r JOIN sheets USING (sheet_id) WHERE trim(t) <> '' UNION ALL SELECT sheet_id, 0, 't c', 'generic_section', name || ' > t' FROM sheets WHERE sheet_id % 5 = 0 UNION ALL SELECT sheet_id, 1, name || ' 区块 2 no title', 'generic_section', name || ' > ' || name || ' 区块 2' FROM sheets WHERE sheet_id % 5 = 0",
        r="SELECT sheet_id, string_agg(l, chr(10) ORDER BY row) t FROM (SELECT sheet_id, row, string_agg(text, ' ' ORDER BY col) l FROM cells GROUP BY ALL) GROUP BY sheet_id",
    ),
    "tokenize_terms": "SELECT item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) n_tokens, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') terms FROM benchmark",
    "term_stats": _with(["tok"], "SELECT term, count(DISTINCT doc_id) df, count(*) tf FROM tok GROUP BY term"),
    "corpus_stats": _with(["stats"], "SELECT n_rows, round(avg_len, 6) avg_len FROM stats"),
    "bm25_topk": _with(["fts"], f"SELECT query_id, chunk_id, {_RANKED} FROM fts"),
    "bm25_chunks_and_summaries": _with(
        ["tok", "qt", "lines"],
        f"SELECT query_id, chunk_id, {_RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM (SELECT query_id, chunk_id, max(score) score FROM both_bm WHERE place <= 60 GROUP BY ALL)) WHERE rank < 30",
        rows_of_both="SELECT 'chunk' kind, doc_id ref_id, doc_id chunk_id, term FROM tok UNION ALL SELECT 'summary', doc_id * 1000000 + line_no, doc_id, unnest(list_filter(string_split_regex(lower(line), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) FROM lines",
        both_len="SELECT kind, ref_id, count(*) dl FROM rows_of_both GROUP BY ALL",
        both_stats="SELECT count(*) n_rows, avg(dl) avg_len FROM both_len",
        both_hit="SELECT qt.query_id, qt.i, qt.need, kind, ref_id, chunk_id, count(*) tf FROM qt JOIN rows_of_both USING (term) GROUP BY ALL",
        both_df="SELECT query_id, i, count(*) df FROM both_hit GROUP BY ALL",
        both_bm="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kind, ref_id) place FROM (SELECT query_id, kind, ref_id, chunk_id, sum(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) score FROM both_hit JOIN both_df USING (query_id, i) JOIN both_len USING (kind, ref_id), both_stats GROUP BY ALL HAVING count(*) = any_value(need))",
    ),
    "phrase_match": _with(["tok"], "SELECT p.item_id query_id, a.doc_id, count(*) tf FROM p JOIN tok a ON a.term = p.t[1] JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = p.t[2] GROUP BY ALL", p="SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') t FROM benchmark"),
    "exact_recall": """WITH t AS (SELECT n_nationkey::BIGINT query_id, unnest(['N_0' || lpad(n_nationkey::VARCHAR, 2, '0'), 'SUPPLIER-00000000' || (n_nationkey % 10)]) tk FROM nation),
h AS (SELECT query_id, tk, s_suppkey chunk_id, row_number() OVER (PARTITION BY query_id, tk ORDER BY s_suppkey) i FROM t JOIN supplier ON upper(replace(s_name, '#', '-')) ILIKE '%' || tk || '%' OR 'nation N_' || lpad(s_nationkey::VARCHAR, 3, '0') ILIKE '%' || tk || '%')
SELECT * FROM (SELECT query_id, chunk_id, count(DISTINCT tk)::DOUBLE score, row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT tk) DESC, chunk_id) - 1 AS rank FROM h WHERE i <= 30 GROUP BY query_id, chunk_id) WHERE rank < 30""",
    "knn_topk": _with(["vc"], f"SELECT query_id, chunk_id, {_RANKED} FROM vc"),
    "knn_scoped_post": _with(["vc", "docs"], "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM vc JOIN docs ON docs.id = chunk_id WHERE folder_id = query_id % 20"),
    "knn_scoped_pre": _with(["sims", "docs"], "SELECT * FROM (SELECT query_id, s.id chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id) - 1 AS rank FROM sims s JOIN docs ON docs.id = s.id WHERE folder_id = query_id % 20) WHERE rank < 30"),
    "summary_knn_best": _with(["vs"], f"SELECT query_id, chunk_id, {_RANKED} FROM vs"),
    "rrf_fusion": _with(["fused"], f"SELECT query_id, chunk_id, sources, {_RANKED} FROM fused"),
    "hybrid_search": _with(["best"], f"SELECT query_id, chunk_id, 'doc_' || chunk_id filename, 'sheet ' || source sheet_name, sources, {_RANKED} FROM best"),
    "context_citations": _with(["best"], "SELECT q.query_id, coalesce(string_agg('[#' || (rank + 1) || '] 文件: doc_' || chunk_id || ' | 工作表: sheet ' || source || ' (unknown) | 层级: -' || chr(10) || text, chr(10) || chr(10) ORDER BY rank), '没有检索到相关内容。') context FROM q LEFT JOIN best USING (query_id) GROUP BY q.query_id"),
    "citation_join": "SELECT conv_id, turn, turn + 1 AS n, length(text) cited FROM conversations UNION ALL SELECT a.conv_id, a.turn, 9, length(b.text) FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 8 WHERE a.turn <> 8",
    "confidence_band": "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'no mark' ELSE 'answer' END body, c confidence, CASE WHEN c >= 8 THEN 'green' WHEN c >= 5 THEN 'accent' WHEN c >= 0 THEN 'red' ELSE 'none' END band FROM (SELECT *, CASE WHEN turn % 3 <> 2 THEN (conv_id + turn) % 11 END c FROM conversations)",
    "enrich_gate": _with(["chunks"], "SELECT id FROM chunks WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 80"),
    "section_parse": "SELECT n_nationkey::BIGINT id, n_name technical, 'b1' business, 'k1 k2' keywords FROM nation",
    "json_default": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) END k FROM events",
    "progress_latest": "SELECT user_id document_id, arg_max(event_type, (ts, event_type)) stage, count(*) n_events FROM events GROUP BY user_id",
    "progress_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type stage, count(*) n FROM events GROUP BY ALL",
    "preview_chunks": _with(["chunks"], "SELECT sheet_id, chunk_order, t AS text FROM (SELECT document_id sheet_id, chunk_order, left(text, 20) t, row_number() OVER (PARTITION BY document_id ORDER BY chunk_order) i FROM chunks) WHERE i <= 3"),
    "output_counters": _with(["chunks", "cells"], "SELECT d.doc_id sheet_id, (SELECT count(*) FROM chunks c WHERE c.document_id = d.doc_id) n_chunks, (SELECT count(*) FROM cells c WHERE c.sheet_id = d.doc_id) n_cells, (SELECT count(*) FROM embeddings e WHERE e.vec_id % 100 = d.doc_id) n_summaries FROM documents d"),
    "folder_totals": _with(["chunks"], "SELECT (SELECT count(*) FROM docs) n_documents, (SELECT count(*) FROM chunks) n_chunks"),
    "sheet_inspect_preview": _with(["cells"], "SELECT d.doc_id sheet_id, count(c.text) n_cells, count(DISTINCT c.row) n_rows FROM documents d LEFT JOIN cells c ON c.sheet_id = d.doc_id GROUP BY d.doc_id"),
    "citation_anchors": "SELECT conv_id, turn, 'as <a href=\"#cite-' || (turn + 1) || '\">[' || (turn + 1) || ']</a> says [#x]' html FROM conversations",
    "query_strings": "SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ' ') q FROM benchmark",
    "column_letters": "SELECT s_suppkey, CASE WHEN s_suppkey < 26 THEN chr((65 + s_suppkey)::INT) WHEN s_suppkey < 702 THEN chr((65 + (s_suppkey - 26) // 26)::INT) || chr((65 + (s_suppkey - 26) % 26)::INT) ELSE chr((65 + (s_suppkey - 702) // 676)::INT) || chr((65 + (s_suppkey - 702) // 26 % 26)::INT) || chr((65 + (s_suppkey - 702) % 26)::INT) END letter FROM supplier",
    "safe_file_names": "SELECT p_partkey, substring(regexp_replace(p_name || '/' || p_brand, '[^\\p{L}\\p{N}\\-_.]', '_', 'g'), 1, 60) AS name FROM part",
    "palette_colors": "SELECT n_nationkey::BIGINT id, CASE WHEN n_nationkey % 3 = 0 THEN '#00AA11' WHEN n_nationkey % 3 = 1 THEN '#' || ['000000', 'FFFFFF', 'FF0000', '00FF00', '0000FF', 'FFFF00', 'FF00FF', '00FFFF'][n_nationkey % 8 + 1] ELSE 'none' END color FROM nation",
    "issue_codes": "SELECT s_suppkey, 'DBL-' || s_suppkey || ',KAIZEN-7' codes FROM supplier",
    "events_until_terminal": "WITH e AS (SELECT user_id document_id, ts, event_type FROM events), f AS (SELECT document_id, min(ts) t FROM e WHERE event_type IN ('purchase', 'done', 'error') GROUP BY ALL) SELECT e.document_id, count(*) n FROM e LEFT JOIN f USING (document_id) WHERE t IS NULL OR ts <= t GROUP BY e.document_id",
}
