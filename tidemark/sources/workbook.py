"""Spreadsheet workbooks (XLSX) as long cell tables, and documentation pages as records.

A workbook is zipped XML: each file is read by one task from its bytes (binaryFile), streamed cell by cell.  Cells have
a kind (text, number, boolean, error, date, empty); number text is withheld unless asked for."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.series import stop_if_any

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates (fixed by the file format).
DATES = frozenset([*range(14, 23), 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58])
CELL = "sheet string, row int, col int, kind string, text string"


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = 26 * n + ord(ch) - 64
    return n


def is_date_code(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", code)  # quoted, bracketed, escaped, padding
    return bool(re.search(r"[dmyhs]", re.sub("general", "", bare, flags=re.I), re.I))


class Workbook:
    """One workbook's parts, read lazily from bytes."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        root = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): "xl/" + rels[s.get(REL)].lstrip("/").removeprefix("xl/") for s in root.iter(f"{NS}sheet")}
        props = root.find(f"{NS}workbookPr")
        self.date1904 = props is not None and props.get("date1904") in ("1", "true")
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{NS}si"):
                self.shared.append("".join(t.text or "" for t in si.iter(f"{NS}t")))
        self.date_styles: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{NS}numFmt")}
            xfs = styles.find(f"{NS}cellXfs")
            for k, xf in enumerate(xfs if xfs is not None else ()):
                code = int(xf.get("numFmtId", 0))
                if code in DATES or is_date_code(own.get(code, "")):
                    self.date_styles.add(k)

    def cells(self, sheet: str, numbers: bool = False, max_row: int | None = None, columns: set[int] | None = None) -> Iterator[tuple]:
        """(row, col, kind, text); rows beyond max_row and other columns are never classified."""
        for _, el in ET.iterparse(self.zip.open(self.sheets[sheet])):
            if el.tag != f"{NS}row":
                continue
            r = int(el.get("r", 0))
            if max_row and r > max_row:
                return
            for x in el.iter(f"{NS}c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", x.get("r", ""))
                if not m or columns and column_number(m[1]) not in columns:
                    continue
                yield r, column_number(m[1]), *self._classify(x, numbers)
            el.clear()

    def _classify(self, x, numbers: bool) -> tuple[str, str | None]:
        t, v = x.get("t", "n"), x.findtext(f"{NS}v")
        if t in ("s", "inlineStr", "str"):
            text = self.shared[int(v)] if t == "s" else v if t == "str" else "".join(e.text or "" for e in x.iter(f"{NS}t"))
            return ("text", text) if text and text.strip() else ("empty", None)
        if t == "d":
            return ("date", v) if v else ("empty", None)
        if t == "b":
            return "boolean", v
        if t == "e":
            return "error", v
        if v is None or v == "":
            return "empty", None
        return ("date", v) if int(x.get("s", 0)) in self.date_styles else ("number", v if numbers else None)

    def merged(self, sheet: str) -> list[str]:
        return [m.get("ref") for _, m in ET.iterparse(self.zip.open(self.sheets[sheet])) if m.tag == f"{NS}mergeCell"]

    def notes(self, sheet: str) -> Iterator[tuple[str, str, str]]:
        """(cell, kind, text) of a sheet's notes and threaded comments, from the parts that its relationships name."""
        at = self.sheets[sheet]
        folder, name = at.rsplit("/", 1)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.zip.namelist():
            return
        for r in ET.fromstring(self.zip.read(rels)):
            kind = r.get("Type", "").rsplit("/", 1)[-1]
            if kind not in ("comments", "threadedComment"):
                continue
            target = r.get("Target")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
            for el in ET.fromstring(self.zip.read(part)).iter():
                if el.tag.rsplit("}", 1)[-1] in ("comment", "threadedComment"):
                    text = "".join(t.text or "" for t in el.iter() if t.tag.rsplit("}", 1)[-1] in ("t", "text"))
                    yield el.get("ref"), "note" if kind == "comments" else "comment", text

    def properties(self) -> Iterator[tuple[str, str]]:
        """(name, text) of the document properties, core, application's and custom, that have a text."""
        for part in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
            if part in self.zip.namelist():
                for el in ET.fromstring(self.zip.read(part)):
                    text = "".join(el.itertext()).strip()
                    if text:
                        yield el.get("name") or el.tag.rsplit("}", 1)[-1], text


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Part(p) for p in self.options["path"].split(",")]

    def read(self, partition):
        with open(partition.path.removeprefix("file:"), "rb") as f:
            book = Workbook(f.read())
        numbers = self.options.get("numbers", "false") == "true"
        top = int(self.options["max_row"]) if "max_row" in self.options else None
        cols = {int(x) for x in self.options["columns"].split(",")} if "columns" in self.options else None
        for sheet in book.sheets:
            for cell in book.cells(sheet, numbers, top, cols):
                yield (sheet, *cell)


class WorkbookSource(DataSource):
    """spark.read.format("tidemark_xlsx").option("numbers", ..).option("max_row", ..).option("columns", "1,3").load(path);
    for files on a path that Python can open.  xlsx_cells() reads through Spark instead."""

    @classmethod
    def name(cls):
        return "tidemark_xlsx"

    def schema(self):
        return CELL

    def reader(self, schema):
        return WorkbookReader(self.options)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all workbooks at a Spark path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def _each_book(books: DataFrame, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                found = iter(rows(Workbook(content)))
                while some := [(path, *x) for _, x in zip(range(50_000), found)]:
                    yield pd.DataFrame(some, columns=names)

    return books.select("path", "content").mapInPandas(run, schema)


def cells_of(books: DataFrame, numbers: bool = False, max_row: int | None = None, columns: set[int] | None = None) -> DataFrame:
    """Cells of workbooks (path, content): path, sheet, row, col, kind, text."""
    return _each_book(books, "path string, " + CELL, lambda w: ((s, *x) for s in w.sheets for x in w.cells(s, numbers, max_row, columns)))


def merged_of(books: DataFrame) -> DataFrame:
    """Merged ranges of workbooks: path, sheet, top, left, bottom, right."""
    corner = re.compile(r"([A-Z]+)([0-9]+)(?::([A-Z]+)([0-9]+))?")

    def rows(w):
        for s in w.sheets:
            for ref in w.merged(s):
                a, b, c, d = corner.fullmatch(ref).groups()
                yield s, int(b), column_number(a), int(d or b), column_number(c or a)

    return _each_book(books, "path string, sheet string, top int, left int, bottom int, right int", rows)


def notes_of(books: DataFrame) -> DataFrame:
    """Notes and comments of workbooks, by cell, and document properties (sheet and cell are null): path, sheet, ref, kind, text."""

    def rows(w):
        yield from ((s, *x) for s in w.sheets for x in w.notes(s))
        yield from ((None, name, "property", text) for name, text in w.properties())

    return _each_book(books, "path string, sheet string, ref string, kind string, text string", rows)


def xlsx_cells(spark: SparkSession, path: str, numbers: bool = False, max_row: int | None = None, columns: set[int] | None = None) -> DataFrame:
    """Cells of all workbooks at a Spark path: path, sheet, row, col, kind, text."""
    return cells_of(files(spark, path), numbers, max_row, columns)


# ------------------------------------------------ writing
_HEAD = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_KIN = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def book_bytes(sheets: dict[str, list[tuple]], merged: dict[str, list[str]], notes: dict[str, list[tuple]], properties: dict[str, str]) -> bytes:
    """An XLSX file of (row, col, kind, text) cells, sorted; text is inline, other kinds keep their stored form."""
    form = {"number": "<c r=\"{0}\"><v>{1}</v></c>", "date": "<c r=\"{0}\" s=\"1\"><v>{1}</v></c>", "boolean": "<c r=\"{0}\" t=\"b\"><v>{1}</v></c>", "error": "<c r=\"{0}\" t=\"e\"><v>{1}</v></c>", "text": "<c r=\"{0}\" t=\"inlineStr\"><is><t>{1}</t></is></c>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)  # noqa: E731  equal cells, equal bytes
        put("xl/workbook.xml", f"<workbook {_HEAD}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", _RELS.format("".join(f'<Relationship Id="rId{k}" Type="{_KIN}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))))
        put("xl/styles.xml", f'<styleSheet {_HEAD}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        put("docProps/core.xml", "<properties>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in properties.items()) + "</properties>")
        for k, (name, cells) in enumerate(sheets.items(), 1):
            body, row = [], None
            for r, c, kind, text in cells:
                if r != row:
                    body.append(("</row>" if row else "") + f'<row r="{r}">')
                    row = r
                body.append(form[kind].format(f"{letters(c)}{r}", escape(text)))
            spans = "".join(f'<mergeCell ref="{m}"/>' for m in merged.get(name, ()))
            put(f"xl/worksheets/sheet{k}.xml", f"<worksheet {_HEAD}><sheetData>{''.join(body)}{'</row>' if row else ''}</sheetData>" + (f"<mergeCells>{spans}</mergeCells>" if spans else "") + "</worksheet>")
            if notes.get(name):
                put(f"xl/worksheets/_rels/sheet{k}.xml.rels", _RELS.format(f'<Relationship Id="rId1" Type="{_KIN}/comments" Target="../comments{k}.xml"/>'))
                put(f"xl/comments{k}.xml", f"<comments {_HEAD}><commentList>" + "".join(f'<comment ref="{ref}"><text><t>{escape(t)}</t></text></comment>' for ref, t in notes[name]) + "</commentList></comments>")
    return out.getvalue()


def books(cells: DataFrame) -> DataFrame:
    """name, content of the workbooks that cells make, a task a workbook: cells has book, sheet, row, col, kind, text, and kind may be
    merged (text is the range), note (row and col are the cell) or property (sheet is the property's name)."""

    def make(key, pdf):
        pdf = pdf.sort_values(["sheet", "row", "col"])
        plain = pdf[~pdf.kind.isin(["merged", "note", "property"])]
        sheets = {s: list(zip(g.row, g.col, g.kind, g.text)) for s, g in plain.groupby("sheet")}
        merged = {s: list(g.text) for s, g in pdf[pdf.kind == "merged"].groupby("sheet")}
        notes = {s: [(f"{letters(c)}{r}", t) for r, c, t in zip(g.row, g.col, g.text)] for s, g in pdf[pdf.kind == "note"].groupby("sheet")}
        own = pdf[pdf.kind == "property"]
        return pd.DataFrame({"name": [f"{key[0]}.xlsx"], "content": [book_bytes(sheets, merged, notes, dict(zip(own.sheet, own.text)))]})

    return cells.groupBy("book").applyInPandas(make, "name string, content binary")


def find_blocks(cells: DataFrame) -> DataFrame:
    """Runs of neighbouring filled columns in each sheet's first row: path, sheet, first, last."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "sheet").orderBy("col")
    head = cells.where("row = 1 and kind <> 'empty'").withColumn("island", F.col("col") - F.row_number().over(w))
    return head.groupBy("path", "sheet", "island").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("island")


def extract_levels(cells: DataFrame, sheet: str, year_col: int, value_col: int) -> DataFrame:
    """year, level of a sheet of each workbook: the two columns meet by row.  Rows before the first whole year and behind
    the last are left out; between them a filled row without a whole year stops."""
    c = cells.where((F.col("sheet") == sheet) & F.col("col").isin(year_col, value_col) & (F.col("kind") != "empty"))
    at = lambda k, v: F.max(F.when(F.col("col") == k, v))
    rows = c.groupBy("path", "row").agg(at(year_col, F.col("text")).alias("y"), at(value_col, F.expr("try_cast(text as double)")).alias("level"), F.count_if(F.col("col") == value_col).alias("n"))
    rows = rows.withColumn("year", F.when(F.col("y").rlike(r"^\d{4}(\.0+)?$"), F.substring("y", 1, 4).cast("int")))
    ends = rows.where("year is not null").groupBy("path").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    inside = rows.join(ends, "path").where("row between first and last")
    stop_if_any(inside.where("year is null"), "a row of the sample has no whole year")
    return inside.where("n > 0").select("year", "level")


# ------------------------------------------------ pages
class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.heads, self._in, self._skip, self._titles = "", [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "template", "noscript"):
            self._skip += 1
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag in ("title", "h1", "h2", "h3"):
            self._in.append(tag)
            self._titles += tag == "title"

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self._skip = max(0, self._skip - 1)
        elif self._in and tag == self._in[-1]:
            self._in.pop()

    def handle_data(self, data):
        if self._skip or not self._in:
            return
        if self._in[-1] == "title":
            self.title += data if self._titles == 1 else ""
        else:
            self.heads.append(" ".join(data.split()))


DAY = re.compile(r"\b(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})\b")


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html", decode: bool = True) -> DataFrame:
    """key, title (the first one, its white space folded), headings, links and the one date that all mentions agree on (NULL
    otherwise); all NULL without html.  decode=False leaves character references as they are written."""

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[html]):
                if text is None:
                    rows.append((k, None, None, None, None))
                    continue
                p = _Page()
                p.feed(text if decode else text.replace("&", "&amp;"))
                days = set(DAY.findall(re.sub(r"<[^>]*>", " ", text)))
                rows.append((k, re.sub(r"[\t\n\f\r ]+", " ", p.title).strip(" "), p.heads, p.links, days.pop() if len(days) == 1 else None))
            yield pd.DataFrame(rows, columns=[key, "title", "headings", "links", "day"])

    return pages.select(key, html).mapInPandas(run, f"{key} long, title string, headings array<string>, links array<string>, day string")
