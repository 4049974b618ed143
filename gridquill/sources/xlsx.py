"""Workbook source: OOXML read with the standard library, one task per file.

``read_workbooks`` gives four tables from one pass of ``binaryFile`` + ``mapInPandas``: sheets,
cells, images and errors. Rich text keeps its runs, formulas stay text, dates become
``YYYY-MM-DD HH:MM:SS``; a file or sheet that cannot be read gives an error row, not a failed job.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import posixpath
import re
import zipfile
from itertools import batched
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import PALETTE
from ..schemas import DDL
from ..storage import stored

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
BLANK = "　 \t\r\n"
RECORD = "path string, kind string, payload string, bytes binary"


def letters_to_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def number_to_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.strings = self._strings()
        self._styles()

    def xml(self, name: str):
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, str]:
        folder, file = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id")] = target if r.get("TargetMode") == "External" else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
        return out

    def color(self, e) -> str | None:
        if e is None:
            return None
        if rgb := e.get("rgb"):
            return None if rgb == "00000000" else f"#{rgb[-6:].upper()}"
        if (i := e.get("indexed")) is not None:
            return f"#{PALETTE[int(i)]}" if 0 <= int(i) < len(PALETTE) else None
        return None

    def _runs(self, e) -> list[dict]:
        out = []
        for r in e.findall(f"{MAIN}r"):
            p = r.find(f"{MAIN}rPr")
            has = lambda tag, p=p: p is not None and (x := p.find(f"{MAIN}{tag}")) is not None and x.get("val", "1") not in ("0", "none")
            out.append({"text": r.findtext(f"{MAIN}t") or "", "color": self.color(p.find(f"{MAIN}color")) if p is not None else None, "bold": has("b"), "italic": has("i"), "underline": has("u")})
        return out

    def _strings(self) -> list[tuple[str, list[dict]]]:
        root = self.xml("xl/sharedStrings.xml")
        return [(s.findtext(f"{MAIN}t") or "", self._runs(s)) for s in root.findall(f"{MAIN}si")] if root is not None else []

    def _styles(self) -> None:
        root = self.xml("xl/styles.xml")
        find = lambda tag: root.find(f"{MAIN}{tag}") if root is not None else None
        flag = lambda f, tag: (x := f.find(f"{MAIN}{tag}")) is not None and x.get("val", "1") != "0"
        size = lambda f: float(x.get("val")) if (x := f.find(f"{MAIN}sz")) is not None else None
        fonts = [{"color": self.color(f.find(f"{MAIN}color")), "bold": flag(f, "b"), "italic": flag(f, "i"), "size": size(f)} for f in (find("fonts") if find("fonts") is not None else ())]
        fills = []
        for f in find("fills") if find("fills") is not None else ():
            p = f.find(f"{MAIN}patternFill")
            fills.append(self.color(p.find(f"{MAIN}fgColor")) if p is not None and p.get("patternType") not in (None, "none") else None)
        formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in (find("numFmts") if find("numFmts") is not None else ())}
        is_date = lambda i: i in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(i, "")).lower()))
        self.styles = [(fonts[int(x.get("fontId", 0))] if fonts else {}, fills[int(x.get("fillId", 0))] if fills else None, is_date(int(x.get("numFmtId", 0)))) for x in (find("cellXfs") if find("cellXfs") is not None else ())]

    def sheets(self):
        """(index, name, part, visible order as in the file)."""
        book, rels = self.xml("xl/workbook.xml"), self.relations("xl/workbook.xml")
        for i, s in enumerate(book.find(f"{MAIN}sheets")):
            yield i, s.get("name"), rels[s.get(f"{REL}id")]

    def value(self, c, is_date: bool) -> tuple[str, list[dict]]:
        kind, raw = c.get("t", "n"), c.findtext(f"{MAIN}v")
        formula = c.find(f"{MAIN}f")
        if formula is not None and formula.text:
            return "=" + formula.text, []
        if kind == "s" and raw is not None:
            return self.strings[int(raw)]
        if kind == "inlineStr":
            e = c.find(f"{MAIN}is")
            return (e.findtext(f"{MAIN}t") or "", self._runs(e)) if e is not None else ("", [])
        if kind == "b":
            return ("True" if raw == "1" else "False"), []
        if raw is None:
            return "", []
        if kind == "n" and is_date:
            return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(raw) * 86400))), []
        if kind == "n":
            x = float(raw)
            return (str(int(x)) if x == int(x) and "." not in raw and "e" not in raw.lower() else repr(x)), []
        return raw, []

    def read_sheet(self, part: str, max_cells: int):
        """(cells, merged ranges, drawing part or None); stops before a row once max_cells are read."""
        root, cells = self.xml(part), []
        merged = [m.get("ref") for m in root.iter(f"{MAIN}mergeCell")]
        anchors = {m.split(":")[0]: m for m in merged}
        rels = self.relations(part)
        links = {h.get("ref"): rels.get(h.get(f"{REL}id"), h.get("location")) for h in root.iter(f"{MAIN}hyperlink")}
        leftmost: dict[int, int] = {}
        for row in root.iter(f"{MAIN}row"):
            if len(cells) >= max_cells:
                break
            for c in row.findall(f"{MAIN}c"):
                ref = c.get("r")
                style = self.styles[int(c.get("s", 0))] if self.styles else ({}, None, False)
                text, runs = self.value(c, style[2])
                text = "".join(r["text"] for r in runs) if runs else text.strip(BLANK)
                if not text:
                    continue
                letters = re.match("[A-Z]+", ref)[0]
                r, col = int(ref[len(letters) :]), letters_to_number(letters)
                font = style[0]
                leftmost[r] = min(col, leftmost.get(r, col))
                cells.append({
                    "row": r, "col": col, "col_letter": letters, "text": text, "runs": runs,
                    "font_color": next((x["color"] for x in runs if x["color"]), font.get("color")), "fill_color": style[1],
                    "bold": bool(font.get("bold")) or any(x["bold"] for x in runs), "italic": bool(font.get("italic")) or any(x["italic"] for x in runs),
                    "font_size": font.get("size"), "is_merge_anchor": ref in anchors, "merged_range": anchors.get(ref), "hyperlink": links.get(ref),
                })
        levels = {c: i for i, c in enumerate(sorted(set(leftmost.values())))}
        for c in cells:
            c["indent_level"] = levels[leftmost[c["row"]]]
        drawing = root.find(f"{MAIN}drawing")
        return cells, merged, rels.get(drawing.get(f"{REL}id")) if drawing is not None else None

    def images(self, drawing: str):
        """(index, anchor cell, format, bytes) of the embedded pictures; unreadable ones are skipped."""
        root, rels = self.xml(drawing), self.relations(drawing)
        i = 0
        for anchor in root if root is not None else ():
            start, blip = anchor.find(f"{DRAW}from"), next(anchor.iter(f"{ART}blip"), None)
            target = rels.get(blip.get(f"{REL}embed")) if blip is not None else None
            if target not in self.names:
                continue
            cell = f"{number_to_letters(int(start.findtext(f'{DRAW}col')) + 1)}{int(start.findtext(f'{DRAW}row')) + 1}" if start is not None else None
            yield i, cell, posixpath.splitext(target)[1].lstrip(".").lower(), self.zip.read(target)
            i += 1


def records(path: str, data: bytes, max_cells: int):
    """(path, kind, JSON payload, bytes) for everything in one workbook."""
    try:
        book = Workbook(data)
        parts = list(book.sheets())
    except Exception as e:  # noqa: BLE001 - the file's fault, reported as a row
        yield path, "error", json.dumps({"sheet_index": None, "message": str(e)}), None
        return
    for index, name, part in parts:
        try:
            cells, merged, drawing = book.read_sheet(part, max_cells)
            pictures = list(book.images(drawing)) if drawing else []
        except Exception as e:  # noqa: BLE001 - one sheet's failure leaves the others
            yield path, "error", json.dumps({"sheet_index": index, "message": str(e)}), None
            continue
        size = {"max_row": max((c["row"] for c in cells), default=0), "max_col": max((c["col"] for c in cells), default=0)}
        yield path, "sheet", json.dumps({"sheet_index": index, "name": name, "has_images": bool(pictures), "merged_ranges": merged} | size, ensure_ascii=False), None
        for c in cells:
            yield path, "cell", json.dumps(c | {"sheet_index": index}, ensure_ascii=False), None
        for i, cell, fmt, payload in pictures:
            yield path, "image", json.dumps({"sheet_index": index, "image_index": i, "anchor_cell": cell, "format": fmt}), payload


def read_workbooks(spark: SparkSession, path: str, max_cells: int = 20_000) -> dict[str, DataFrame]:
    """sheets, cells, images, errors of all workbooks under ``path`` (document_id: hash of the path)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return from_files(files, max_cells)


def from_files(files: DataFrame, max_cells: int = 20_000) -> dict[str, DataFrame]:
    """As read_workbooks, for (path, content) rows, such as a streaming micro-batch. The workbooks are parsed
    once, when this is called; the four tables are read from what the parser wrote, which leaves a task some thousand
    records at a time."""

    def parse(frames):
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                for rows in batched(records(p, bytes(content), max_cells), 5_000):
                    yield pd.DataFrame(list(rows), columns=["path", "kind", "payload", "bytes"])

    every = stored(files.mapInPandas(parse, RECORD).withColumn("document_id", F.xxhash64("path")), "workbooks")

    def pick(kind: str, ddl: str, *extra: str) -> DataFrame:
        fields = ", ".join(x for x in ddl.split(", ") if not x.startswith(("document_id ", "bytes ")))
        return every.where(F.col("kind") == kind).select("document_id", *extra, F.from_json("payload", fields).alias("x")).select("document_id", "x.*", *extra)

    return {"sheets": pick("sheet", DDL["sheets"]), "cells": pick("cell", DDL["cells"]), "images": pick("image", DDL["images"], "bytes"), "errors": pick("error", "sheet_index int, message string")}
