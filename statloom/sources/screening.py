"""What files are by their content, against what their names say.

Spark reads the files' bytes and compares their beginnings with a table of signatures; only archives that pass as
workbooks are looked into, by the rules of their packaging format: every part has a declared content type, one of them
is the workbook, and macros are a content type of their own.
"""

from __future__ import annotations

import io
import zipfile
from fnmatch import fnmatch
from xml.etree.ElementTree import ParseError, fromstring

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How files of these formats begin, as their specifications say.
SIGNATURES = {
    "spss": [b"$FL2", b"$FL3"],
    "stata": [b"<stata_dta>", *[bytes([release]) for release in (110, 111, 113, 114, 115)]],
    "zip": [b"PK\x03\x04", b"PK\x05\x06"],
    "pdf": [b"%PDF-"],
    "program": [b"\x7fELF", b"MZ", b"#!"],
    "image": [b"\x89PNG", b"GIF8", b"\xff\xd8\xff"],
    "packed": [b"\x1f\x8b", b"7z\xbc\xaf\x27\x1c", b"Rar!"],
}
#: What a file must be for each suffix; text is anything without a signature and without a zero byte near its start.
EXPECTED = {"csv": "text", "tsv": "text", "txt": "text", "xlsx": "zip", "sav": "spss", "dta": "stata"}
HEAD = 1 << 16
MOST_BYTES = 50 << 20
#: Limits of a workbook's unpacked parts, all of them and the largest one by its own ratio.
MOST_UNPACKED, MOST_SWELLING = 1 << 30, 200
WORKBOOK, MACRO = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", ("*macroenabled*", "*vba*", "*activex*")


def content_kind(content: Column) -> Column:
    """The format whose signature the bytes begin with; text or binary where there is none."""
    by_length = sorted(((s, k) for k, signs in SIGNATURES.items() for s in signs if not (k == "stata" and len(s) == 1)), key=lambda x: -len(x[0]))
    # one letter begins texts too: an old Stata file has its byte order, 1 or 2, and the number 1 behind it
    stata = F.hex(F.substring(content, 1, 3)).isin([(s + bytes([order, 1])).hex().upper() for s in SIGNATURES["stata"] if len(s) == 1 for order in (1, 2)])
    kind = F.when(stata, "stata")
    for sign, name in by_length:
        kind = kind.when(F.startswith(content, F.lit(sign)), name)
    return kind.when(F.contains(F.substring(content, 1, HEAD), F.lit(b"\0")), "binary").otherwise("text")


def workbook_fault(content: bytes) -> str | None:
    """What is wrong with a ZIP archive as a workbook, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            parts = {f"/{i.filename}": i for i in book.infolist() if not i.is_dir()}
            if sum(i.file_size for i in parts.values()) > MOST_UNPACKED or any(i.file_size > max(1 << 20, MOST_SWELLING * i.compress_size) for i in parts.values()):
                return "unpacks to too much"
            listing = parts.pop("/[Content_Types].xml", None)
            types = fromstring(book.read(listing)) if listing else []
    except (zipfile.BadZipFile, ParseError, OSError):
        return "damaged"
    by_suffix = {e.get("Extension", "").lower(): e.get("ContentType", "") for e in types if e.tag.endswith("}Default")}
    by_name = {e.get("PartName"): e.get("ContentType", "") for e in types if e.tag.endswith("}Override")}
    declared = {name: by_name.get(name) or by_suffix.get(name.rpartition(".")[2].lower()) for name in parts}
    if any(fnmatch(t.lower(), pattern) for t in [*by_suffix.values(), *by_name.values()] for pattern in MACRO):
        return "holds macros"
    if WORKBOOK not in declared.values():
        return "not a workbook"
    return "holds parts of no declared type" if None in declared.values() else None


def file_faults(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file, fault (null if none) of each file below path. Larger files than most_bytes are not looked into.

    Empty files don't appear, as Spark's reader leaves them out.
    """

    @F.pandas_udf("string")
    def looked_into(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else workbook_fault(c))

    files = spark.read.format("binaryFile").load(path).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    told = files.withColumn("expected", F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])[F.col("suffix")])
    told = told.withColumn("kind", F.when(F.col("length") <= most_bytes, content_kind(F.col("content"))))
    book = looked_into(F.when((F.col("kind") == "zip") & (F.col("expected") == "zip"), F.col("content")))
    fault = (
        F.when(F.col("expected").isNull(), "unknown format").when(F.col("kind").isNull(), "too large")
        .when(F.col("kind") != F.col("expected"), F.concat(F.lit("is "), F.col("kind"), F.lit(", not "), F.col("expected"))).otherwise(book)
    )
    return told.select(F.col("path").alias("file"), fault.alias("fault"))
