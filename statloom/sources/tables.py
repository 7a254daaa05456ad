"""Reading tables by suffix, with sniffed delimiters, decimal commas and encodings; writing tables and parameters."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.cleaning import clean, clean_names, formula_guard
from statloom.sources.labelled import read_labelled
from statloom.sources.workbook import read_workbook

DELIMITERS = (";", ",", "\t", "|")
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
#: Bytes that windows-1252 and ISO-8859-1 read differently, as the latter reads them. Spark's readers know only the latter.
SPECIAL = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
SAMPLE = 20_000
MOST_COLUMNS = 2000


def sniff(sample: str) -> tuple[str, bool]:
    """Delimiter and whether decimals use a comma, from the head of a file."""
    lines = [x for x in sample.splitlines()[:50] if x.strip()] or [""]
    score = {s: (min(x.count(s) for x in lines), lines[0].count(s)) for s in DELIMITERS}
    best = max(DELIMITERS, key=lambda s: score[s])
    if not any(score[best]):
        best = ";" if lines[0].count(";") > lines[0].count(",") else ","
    return best, best != "," and re.search(r"\d,\d", sample) is not None


def text_form(spark: SparkSession, path: str) -> tuple[str, int]:
    """The encoding of a text file and its number of lines, in one pass over all its bytes.

    UTF-8 where every line is valid UTF-8; else windows-1252, or ISO-8859-1 where bytes occur that the former has no
    character for.
    """
    line = F.col("value")  # as the file's bytes: they are not decoded when lines are split
    unmapped = F.decode(line.cast("binary"), "ISO-8859-1").rlike("[\u0081\u008d\u008f\u0090\u009d]")
    one = spark.read.text(path).agg(F.count("*").alias("n"), F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(unmapped).alias("unmapped")).first()
    return ENCODINGS[0] if one["utf8"] is not False else ENCODINGS[2] if one["unmapped"] else ENCODINGS[1], one["n"]


def head(spark: SparkSession, path: str, encoding: str) -> str:
    """The first characters of a text file, as Spark's readers take them. Only the lines needed are read."""
    lines = spark.read.option("encoding", encoding).text(path).limit(60).collect()  # a bounded head
    return "\n".join(r["value"] for r in lines)[:SAMPLE].removeprefix("\ufeff")


def check_shape(rows: int, columns: int, most_rows: int | None, most_cells: int | None) -> None:
    """An error where a table has more columns than MOST_COLUMNS, or more rows or cells than asked for."""
    if columns > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    if most_rows is not None and rows > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    if most_cells is not None and rows * columns > most_cells:
        raise ValueError(f"more than {most_cells} cells")


def read_delimited(spark: SparkSession, path: str, most_rows: int | None = None, most_cells: int | None = None) -> DataFrame:
    """A delimited file as texts, cleaned: names, null words, numbers with a decimal point or comma.

    Limits on rows and cells, if any, are checked on the number of lines after the header, before columns are parsed.
    """
    encoding, lines = text_form(spark, path)
    readable = ENCODINGS[2] if encoding == ENCODINGS[1] else encoding
    sep, _ = sniff(head(spark, path, readable))
    rows = spark.read.csv(path, header=True, sep=sep, encoding=readable, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", multiLine=False)
    check_shape(max(lines - 1, 0), len(rows.columns), most_rows, most_cells)
    if encoding == ENCODINGS[1]:
        meant = SPECIAL.encode("latin-1").decode("cp1252")
        names = [c.translate(str.maketrans(SPECIAL, meant)) for c in rows.columns]
        rows = rows.select(*[F.translate(F.col(f"`{c}`"), SPECIAL, meant).alias(n) for c, n in zip(rows.columns, names, strict=True)])
    return clean(rows.toDF(*clean_names([c.removeprefix("\ufeff") for c in rows.columns])))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv, tsv, txt, xlsx, sav, dta, json, orc, parquet."""
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    if suffix in ("csv", "tsv", "txt"):
        return read_delimited(spark, path)
    if suffix in ("json", "orc", "parquet"):
        return spark.read.format(suffix).load(path)
    if suffix == "xlsx":
        return read_workbook(spark, path)
    if suffix in ("sav", "dta"):
        return read_labelled(spark, path)
    raise ValueError(f"unknown format {suffix!r}")


def write_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV below path, text cells guarded against formulas; returns the index (name, columns)."""
    for name, df in tables.items():
        flat = df.select(*[formula_guard(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`").cast("string").alias(c) if k.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, k in df.dtypes])
        flat.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    spark = next(iter(tables.values())).sparkSession
    index = spark.createDataFrame([(n, ", ".join(t.columns)) for n, t in tables.items()], "name string, columns string")
    index.write.mode("overwrite").csv(f"{path}/index", header=True)
    return index


def append_log(spark: SparkSession, path: str, who: str, what: str, detail: str = "") -> None:
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(who).alias("who"), F.lit(what).alias("what"), F.lit(detail).alias("detail")).write.mode("append").parquet(path)


def write_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    pairs = [(k, str(v)) for k, v in sorted(parameters.items())]
    spark.createDataFrame(pairs, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def encrypt(df: DataFrame, column: str, key: bytes, purpose: str) -> DataFrame:
    """column as AES-GCM cipher text bound to a purpose."""
    return df.withColumn(column, F.aes_encrypt(F.col(column).cast("string"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(purpose)))


def decrypt(df: DataFrame, column: str, key: bytes, purpose: str) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(purpose)).cast("string"))
