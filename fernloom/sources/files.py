"""File formats without a built-in reader: spreadsheets, dBase tables, Word texts, contact CSVs."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int, list]]:
    """(row number, cells) of the first sheet; only wanted columns are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        for _, row in ElementTree.iterparse(z.open("xl/worksheets/sheet1.xml")):
            if row.tag != f"{NS}row":
                continue
            cells: dict[int, str | None] = {}
            for c in row:
                k = _column_number(c.get("r"))
                if wanted is None or k in wanted:
                    v = c.find(f"{NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{NS}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
                    cells[k] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield int(row.get("r")), [cells.get(k) for k in range(max(cells, default=-1) + 1)]
            row.clear()


def dbf_rows(data: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, list]]:
    """(record number, values as text) of a dBase table; deleted records are left out."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    widths = [data[at + 16] for at in range(32, head - 1, 32)]
    for i in range(count):
        at = head + i * size
        if data[at : at + 1] == b"*":
            continue
        out, at = [], at + 1
        for w in widths:
            out.append(data[at : at + w].decode(encoding).strip() or None)
            at += w
        yield i, out


def docx_lines(data: bytes) -> Iterator[tuple[int, list]]:
    """(paragraph number, [text]) of a Word file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, p in enumerate(ElementTree.parse(z.open("word/document.xml")).getroot().iter(f"{WORD}p")):
            yield i, ["".join(t.text or "" for t in p.iter(f"{WORD}t"))]


def binary_rows(files: DataFrame, reader) -> DataFrame:
    """``(path, row, cells)`` of files read by ``binaryFile``; each file is parsed in one task, files in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(reader(bytes(content)))
                yield pd.DataFrame({"path": path, "row": [n for n, _ in rows], "cells": [c for _, c in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def decode_bytes(content: Column) -> Column:
    """Text of UTF-8, UTF-16 (by its mark) or, else, Latin bytes."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(2)))
    return F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


CONTACT = "first string, last string, url string, email string, company string, position string, connected string"


def contacts(files: DataFrame, text: str = "text") -> DataFrame:
    """Contact rows of ``(path, text)`` files after the header line, with the reason where a row is rejected; repeats in a file count once."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace(F.col(text), "^\ufeff", ""), "\r?\n")).alias("pos", "line"))
    header = lines.where(F.col("line").startswith("First Name,") & (F.col("pos") < 40)).groupBy("path").agg(F.min("pos").alias("head"))
    body = lines.join(header, "path").where((F.col("pos") > F.col("head")) & (F.trim("line") != ""))
    rows = body.select("path", "pos", "line", F.from_csv("line", CONTACT, {"mode": "PERMISSIVE"}).alias("c")).select("path", "pos", "line", "c.*")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    error = F.when(quotes % 2 == 1, "unbalanced quotes").when(F.coalesce("first", F.lit("")) == "", "no name")
    key = F.coalesce("url", F.concat_ws("|", "first", "last", "connected"))
    first = rows.withColumns({"error": error, "key": key}).groupBy("path", "key").agg(F.min_by(F.struct(*rows.columns, "error"), "pos").alias("r"))
    return first.select("r.*")
