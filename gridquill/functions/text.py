"""Tokenization, identifiers, dates, labels and rendering, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns
IDENTIFIER = r"(?U)\b([A-Z][A-Z0-9_]{2,}-?\d+)\b"
ISSUE_CODE = r"(?U)\b([A-Z]{2,}[A-Z0-9]*-\d+)\b"
HISTORY_DATE = r"([0-9]{4})[年./-]([0-9]{1,2})[月./-]([0-9]{1,2})日?"
ROW_DATE = r"[0-9]{4}[/-][0-9]{1,2}([/-][0-9]{1,2})?"
COVER_DATE = r"([0-9]{4})[年/-]([0-9]{1,2})[月/-]([0-9]{1,2})"
CONFIDENCE = r"__CONFIDENCE__\s*[:：]\s*([0-9]+)"
TOKEN = r"(?U)[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]|[^\s\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]+"
NAME_HINTS = [
    (r"表紙|表 紙|cover|封面|首頁|首页", "cover"),
    (r"変更履歴|変更 履歴|履歴|履历|変更履历|change[_ ]?log|history|更新履歴", "history"),
    (r"対象画面|画面一覧|画面リスト|screen[_ ]?list|index|目次|目录", "index"),
    (r"画面|screen|UI|ui|view|レイアウト", "screen"),
    (r"テーブル|table|データ辞書|data[_ ]?dict|カラム|column|レコード", "table"),
    (r"仕様|spec|メモ|memo|備考|note|処理|ルール|rule", "memo"),
]
DICT_FIELDS = [
    ("table_name", r"テーブル名$|テーブル$|table[_ ]?name$|表名$|表名称$"),
    ("table_name_en", r"テーブル名[_ ]?英語|table[_ ]?(name)?[_ ]?en"),
    ("column_name", r"カラム名$|列名$|フィールド名|column[_ ]?name$|项目名|属性名"),
    ("column_name_en", r"カラム名[_ ]?英語|列名[_ ]?英語|column[_ ]?en|英語名"),
    ("description", r"説明|意味|内容|更新内容|備考|description|note|remark"),
]
IMAGE_FORMATS = ("png", "jpg", "jpeg", "gif", "bmp")


def tokens(text: Column) -> Column:
    """Whitespace pieces; kana and ideographs one by one, other runs whole."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.trim(t) != "")


def terms(text: Column) -> Column:
    """Index terms: folded to lower case, cut at everything but letters and digits; accents stay."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index_terms(text: Column) -> Column:
    """terms(index_text(text)) without cutting tokens first: terms end at all that tokens end at, but kana and ideographs."""
    apart = F.regexp_replace(text, r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]", " $0 ")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def query_phrases(text: Column) -> Column:
    """A phrase (array of terms) for each query token that has a term; all must match."""
    return F.filter(F.transform(tokens(text), terms), lambda p: F.size(p) > 0)


def query_string(text: Column) -> Column:
    """Every token quoted, quotes doubled, joined by spaces (AND)."""
    return F.array_join(F.transform(tokens(text), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1)))


def issue_codes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ISSUE_CODE), F.lit(1))))


def first_date(text: Column, pattern: str, sep: str) -> Column:
    """First date of the pattern as y-m-d with ``sep``, zero padded; null if there is none."""
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.when(text.rlike(pattern), F.concat_ws(sep, part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def history_description(line: Column) -> Column:
    """The line without its date and without dashes, bars and blanks around; the line if nothing is left."""
    match = F.regexp_substr(line, F.lit(HISTORY_DATE))
    at = F.instr(line, match)
    cut = F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(match), F.length(line)))
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"^[ \-・|｜\x{3000}\t]+|[ \-・|｜\x{3000}\t]+$", ""), F.lit("")), line)


def name_hint(name: Column) -> Column:
    """Sheet type that a sheet's name hints at: the first pattern found, case blind; else null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(NAME_HINTS):
        out = F.when(name.rlike(f"(?iu){pattern}"), kind).otherwise(out)
    return out


def dict_field(header: Column) -> Column:
    """Dictionary field of a header text: the first pattern found wins; else null."""
    out = F.lit(None).cast("string")
    for field, pattern in reversed(DICT_FIELDS):
        out = F.when(header.rlike(f"(?iu){pattern}"), field).otherwise(out)
    return out


def confidence(answer: Column) -> Column:
    """Number of the first confidence mark, else null."""
    return F.regexp_extract(answer, CONFIDENCE, 1).try_cast("int")


def answer_body(answer: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(answer, CONFIDENCE, ""), r"\s+\z", ""))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 8, "green").when(value >= 5, "accent").when(value >= 0, "red").otherwise("none")


def image_format(fmt: Column) -> Column:
    low = F.lower(fmt)
    return F.when(low.isin(*IMAGE_FORMATS), low).otherwise("png")


def image_digest(payload: Column) -> Column:
    return F.substring(F.sha1(payload), 1, 12)


def safe_file_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_"), 1, 60)


def citation_numbers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[#([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))


def citation_anchors(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\[#([0-9]+)\]", r'<a href="#cite-$1">[$1]</a>')


def strip_fence(payload: Column) -> Column:
    """A JSON answer without its code fence."""
    return F.regexp_replace(F.trim(payload), r"(?s)^```(?:json)?\s*|\s*```$", "")


def json_or_empty(payload: Column) -> Column:
    """Parsed JSON, {} when absent or malformed."""
    return F.coalesce(F.try_parse_json(strip_fence(payload)), F.parse_json(F.lit("{}")))


def labelled_section(text: Column, label: str) -> Column:
    """Body under a label line TECHNICAL, BUSINESS or KEYWORDS; END is a label without a body.
    Lines before the first label are dropped, a label closed by another label overwrites, a
    trailing repeat is ignored."""
    mark = lambda line: F.upper(F.regexp_extract(F.trim(line), r"(?i)\A(technical|business|keywords|end)\s*[:：]?\s*\z", 1))
    state = F.struct(F.lit("").alias("label"), F.lit("").alias("body"), F.lit(None).cast("string").alias("value"))

    def step(a: Column, line: Column) -> Column:
        m = mark(line)
        return F.struct(
            F.when(m != "", m).otherwise(a["label"]).alias("label"),
            F.when(m != "", F.lit("")).otherwise(F.concat(a["body"], F.lit("\n"), line)).alias("body"),
            F.when((m != "") & (a["label"] == label), a["body"]).otherwise(a["value"]).alias("value"),
        )

    end = lambda a: F.coalesce(a["value"], F.when(a["label"] == label, a["body"]), F.lit(""))
    return F.regexp_replace(F.aggregate(F.split(text, "\n"), state, step, end), r"\A\s+|\s+\z", "")


_KEYS = ("text", "value", "name", "description", "title")


def _one(v: Column) -> Column:
    """Text of one JSON value: of an object its first known key, else its JSON."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in _KEYS), F.try_variant_get(v, "$", "string"), F.lit(""))


def tolerant_string(value: Column) -> Column:
    """Text of a loosely shaped JSON value: of an object its text, value, name, description or
    title (else its JSON); of a list its items joined by commas; else the value itself."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(items.isNotNull(), F.array_join(F.transform(items, _one), ", ")).otherwise(_one(value))


def render_description(desc: Column) -> Column:
    """Markdown of a screen description: title, layout, regions with their controls,
    annotations, notes. Anything that is not an object where one is expected is shown as text."""
    get = lambda k: F.try_variant_get(desc, f"$.{k}", "variant")
    text = lambda v: F.coalesce(tolerant_string(v), F.lit(""))
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    field = lambda v, k: F.coalesce(F.nullif(text(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("")), F.lit(None).cast("string"))
    line = lambda k, title: F.when(text(get(k)) != "", F.concat(F.lit(f"**{title}**: "), text(get(k))))

    def region(r: Column) -> Column:
        controls = F.try_variant_get(r, "$.controls", "variant")
        many = F.try_variant_get(controls, "$", "array<variant>")
        rows = F.when(many.isNotNull(), F.transform(many, lambda c: F.concat(F.lit("\n  - "), text(c)))).when(text(controls) != "", F.array(F.concat(F.lit("\n  - "), text(controls)))).otherwise(F.array().cast("array<string>"))
        return F.when(is_object(r), F.concat(F.lit("- "), F.coalesce(field(r, "name"), F.lit("(unnamed)")), F.array_join(rows, ""))).otherwise(F.concat(F.lit("- "), text(r)))

    def note(a: Column) -> Column:
        full = F.concat(F.lit("- "), F.coalesce(field(a, "marker"), F.lit("?")), F.lit(" @ "), F.coalesce(field(a, "location"), F.lit("?")), F.lit(" — "), F.coalesce(field(a, "description"), F.lit("")))
        return F.when(is_object(a), full).otherwise(F.concat(F.lit("- "), text(a)))

    def block(k: str, title: str, show) -> Column:
        items = F.try_variant_get(desc, f"$.{k}", "array<variant>")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}**:\n"), F.array_join(F.transform(items, show), "\n")))

    parts = F.array_compact(F.array(line("screen_title", "画面标题"), line("layout", "布局"), block("regions", "区块与控件", region), block("annotations", "标注", note), line("notes", "备注")))
    usable = F.size(F.map_keys(F.try_variant_get(desc, "$", "map<string,variant>"))) > 0
    return F.when(usable, F.array_join(parts, "\n")).otherwise("_(画面描述生成失败)_")
