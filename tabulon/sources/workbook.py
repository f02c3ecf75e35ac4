"""Folders of ``.xlsx`` workbooks: Spark hands each file to a task, which streams the first sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # fixed values: built-in date and time formats
ROWS_PER_BATCH = 10_000


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    wanted = sheets[0].get(RELATION)
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without sheets")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{MAIN}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _position(reference: str) -> int:
    letters = re.match(r"[A-Z]+", reference).group()
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell, strings: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(value.text))
        return (moment + timedelta(microseconds=500)).isoformat(sep=" ", timespec="milliseconds")
    return value.text


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for i, cell in enumerate(row.findall(f"{MAIN}c")):
                    at = _position(cell.get("r")) if cell.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell_text(cell, strings, dates)
                yield cells
                row.clear()


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            names = _header(next(_sheet_rows(content), []))
            yield pd.DataFrame({"position": range(len(names)), "name": names})


def _header(cells: list[str | None]) -> list[str]:
    return [c if c not in (None, "") else f"Unnamed: {i}" for i, c in enumerate(cells)]


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            sheet = _sheet_rows(content)
            header = _header(next(sheet, []))
            rows: list[dict] = []
            for cells in sheet:
                rows.append({h: c for h, c in zip(header, cells) if c is not None})
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame({"cells": rows})
                    rows = []
            yield pd.DataFrame({"cells": rows})


def load_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of all workbooks under ``path`` as one all-text table; columns are
    matched by header name. A workbook holds at most 1 048 576 rows, the bound of one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    headers = files.mapInPandas(_headers, "position int, name string")
    names = [r["name"] for r in headers.groupBy("name").agg(F.min("position").alias("p")).orderBy("p", "name").collect()]
    body = files.mapInPandas(_unpack, "cells map<string,string>")
    return body.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])

