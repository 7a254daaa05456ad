"""First sheets of XLSX workbooks.

A workbook is one ZIP archive, so a task reads one file; Spark spreads the files of a path over tasks. Rows stream out of
the sheet's XML and are never held whole.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.cleaning import clean, clean_names

#: Widest sheet; blank rows in a row after which a sheet ends; rows handed to Spark at once.
MOST_COLUMNS, MOST_BLANK, BATCH = 2000, 10_000, 2000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _targets(book: zipfile.ZipFile) -> dict[str, str]:
    """Paths of the workbook's parts by relation id."""
    with book.open("xl/_rels/workbook.xml.rels") as part:
        return {e.get("Id"): posixpath.normpath(posixpath.join("xl", e.get("Target").removeprefix("/xl/"))) for _, e in iterparse(part) if _local(e.tag) == "Relationship"}


def _first_sheet(book: zipfile.ZipFile) -> str:
    with book.open("xl/workbook.xml") as part:
        for _, e in iterparse(part):
            if _local(e.tag) == "sheet":
                return _targets(book)[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "id")]
    raise ValueError("a workbook without sheets")


def _shared(book: zipfile.ZipFile) -> list[str]:
    """Texts that cells refer to by number. Phonetic hints aren't part of them."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts, hint = [], set()
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in iterparse(part):
            if _local(e.tag) == "rPh":
                hint |= {id(t) for t in e.iter()}
            elif _local(e.tag) == "si":
                texts.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t" and id(t) not in hint))
                e.clear()
                hint.clear()
    return texts


def column_number(reference: str) -> int:
    """The place, from 0, of a cell such as AB12."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    return {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts, without trailing empty cells; blank rows are left out, and MOST_BLANK of them in
    a row end the sheet. Dates come as the numbers that the sheet holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_first_sheet(book)) as part:
            blank = last = 0
            for _, e in iterparse(part):
                if _local(e.tag) != "row":
                    continue
                row: list[str | None] = []
                for cell in e:
                    value = _value(cell, shared)
                    if value is None:
                        continue
                    at = column_number(cell.get("r")) if cell.get("r") else len(row)
                    if at >= MOST_COLUMNS:
                        raise ValueError(f"more than {MOST_COLUMNS} columns")
                    row += [None] * (at + 1 - len(row))
                    row[at] = value
                number = int(e.get("r") or last + 1)
                e.clear()
                blank = 0 if row else blank + 1
                if blank + max(0, number - last - 1) > MOST_BLANK:
                    return
                last = number
                if row:
                    yield row


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0, the header), cells of the first sheet of each workbook below path."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for i, row in enumerate(sheet_rows(content)):
                    held.append((name, i, row))
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=["file", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row long, cells array<string>")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as cleaned columns; headers that are blank get a name by their place."""
    cells = workbook_cells(spark, path)
    top = cells.where("row = 0").orderBy("file").limit(1).collect()  # one header row
    if not top:
        raise ValueError("the first sheet is empty")
    width = cells.agg(F.max(F.size("cells")).alias("w")).first()["w"]
    given = [c or "" for c in top[0]["cells"]] + [""] * (width - len(top[0]["cells"]))
    names = clean_names([c if c.strip() else f"column {i + 1}" for i, c in enumerate(given)])
    rows = cells.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return clean(rows)
