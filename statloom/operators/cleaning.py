"""Cleaning of freshly read tables, complete cases, value labels, dummy columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that stand for a missing value: fixed values, compared as they are after trimming.
NULL_WORDS = ("", "NA", "N/A", "na", "NaN", ".", "NSP", "nsp")
NUMERIC_SHARE = 0.95
LONGEST_NAME = 60


def clean_names(names: list[str]) -> list[str]:
    """Compatible column names: NFKC, words joined by _, no leading digit, at most 60 characters, no repeats."""
    out: list[str] = []
    for raw in names:
        name = re.sub(r"[^\w-]", "", re.sub(r"\s+", "_", unicodedata.normalize("NFKC", str(raw)).strip())) or "column"
        name = (f"v_{name}" if name[0].isdigit() else name)[:LONGEST_NAME]
        base, k = name, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def null_words(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isin(*NULL_WORDS), F.lit(None)).otherwise(t)


def number(c: Column) -> Column:
    """A text as number, with spaces dropped and a decimal comma read as point; null where it is none."""
    return F.replace(F.regexp_replace(c, r"[\p{Zs}\t]", ""), F.lit(","), F.lit(".")).try_cast("double")


def clean(df: DataFrame) -> DataFrame:
    """Clean names, trim texts, map null words, turn text columns into numbers where 95 % of their values are; drop empty
    columns and rows."""
    df = df.toDF(*clean_names(df.columns))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    df = df.select(*[null_words(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])
    counts = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.count(number(F.col(c))).alias(f"k_{c}") for c in texts]).first()
    kept = [c for c in df.columns if counts[f"n_{c}"]]
    numeric = {c for c in texts if counts[f"n_{c}"] and counts[f"k_{c}"] >= NUMERIC_SHARE * counts[f"n_{c}"]}
    return df.select(*[number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in kept]).na.drop(how="all")


def complete_cases(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in columns, and one row with n_total, n_used and the share left out."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    told = df.agg(F.count("*").alias("n_total"), F.count_if(full).alias("n_used"))
    return df.where(full), told.withColumn("left_out", 1.0 - F.col("n_used") / F.nullif(F.col("n_total").cast("double"), F.lit(0.0)))


def apply_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """column with codes replaced by labels (code, label); codes without a label stay as text. labels is a dictionary."""
    named = labels.select(F.col("code").cast("string").alias("_code"), F.col("label").alias("_label"))
    joined = df.join(named, F.col(column).cast("string") == F.col("_code"), "left")
    return joined.select(*[F.coalesce("_label", F.col(column).cast("string")).alias(column) if c == column else F.col(c) for c in df.columns])


def dummies(df: DataFrame, column: str, levels: list[str], reference: str) -> DataFrame:
    """A 0/1 column, named column[level], for each level but the reference."""
    text = F.col(column).cast("string")
    return df.select("*", *[(text == level).cast("double").alias(f"{column}[{level}]") for level in levels if level != reference])


#: Answers that are taken as the reference or the event of a binary variable.
NEGATIVE_WORDS = ("no", "non", "false", "0", "never", "absent", "none", "n")
POSITIVE_WORDS = ("yes", "oui", "true", "1", "present", "y")


def reference_level(counts: dict[str, int], kind: str) -> str:
    """Binary: a negative answer if there is one; ordinal: the first; else the most frequent (ties: the first by name)."""
    names = list(counts)
    if kind == "binary":
        negative = [c for c in names if c.strip().lower() in NEGATIVE_WORDS]
        if negative:
            return negative[0]
    if kind == "ordinal":
        return names[0]
    return min(names, key=lambda c: (-counts[c], c))


def event_level(names: list[str], chosen: str | None = None) -> str:
    """The user's choice, else a positive answer, else the last category."""
    if chosen in names:
        return chosen
    return next((c for c in names if c.strip().lower() in POSITIVE_WORDS), names[-1])


def formula_guard(c: Column) -> Column:
    """A cell that a spreadsheet would run gets a leading apostrophe; negative numbers, also with spaces between their
    digits, and percentages stay."""
    risky = c.rlike(r"^[=+\-@\t\r|]") & ~c.rlike(r"^-?[0-9\p{Zs}.,]+%?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)
