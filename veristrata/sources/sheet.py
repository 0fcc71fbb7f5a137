"""The first worksheet of XLSX and XLSM files as cells, read with the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import date, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veristrata.sources.tabular import CELLS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The built-in number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22}


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    link = workbook.find(f"{_MAIN}sheets/{_MAIN}sheet").get(_REL)
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == link:
            return posixpath.normpath(posixpath.join("xl", r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:]
    raise ValueError("the workbook has no worksheet")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
    return {i for i, x in enumerate(styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _place(ref: str) -> int:
    """Column number from 0 of a reference such as AB12."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(data: bytes) -> list[list[str]]:
    """Cells of every row as text; dates are ISO dates, empty cells empty text."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates, sheet = _date_styles(book), ElementTree.fromstring(book.read(_first_sheet(book)))

    def value(c) -> str:
        kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if v is None:
            return ""
        if kind == "s":
            return shared[int(v)]
        if kind == "b":
            return str(v == "1")
        if kind == "n" and int(c.get("s", 0)) in dates:
            return (date(1899, 12, 30) + timedelta(days=int(float(v)))).isoformat()
        return v[:10] if kind == "d" else v

    out = []
    for r in sheet.iter(f"{_MAIN}row"):
        at = int(r.get("r", len(out) + 1))
        out += [[] for _ in range(at - 1 - len(out))]
        cells: list[str] = []
        for c in r.findall(f"{_MAIN}c"):
            k = _place(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (k - len(cells)) + [value(c)]
        out.append(cells)
    wide = max(map(len, out), default=0)
    return [r + [""] * (wide - len(r)) for r in out]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_num from 1, cells) of the first worksheet of all files under path."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = rows(data)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(range(1, len(found) + 1), pa.int32()), pa.array(found, pa.list_(pa.string()))], ["file", "row_num", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def is_pdf(name: str, head: bytes) -> bool:
    return name.lower().endswith(".pdf") or head[:4] == b"%PDF"
