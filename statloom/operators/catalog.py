"""Measurement levels of columns, inferred from one aggregate by a first-match list of rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructField, TimestampNTZType, TimestampType

KINDS = ("identifier", "binary", "nominal", "ordinal", "count", "continuous", "date", "text")
#: Limits of the rules.
MAX_CATEGORIES, MANY_CATEGORIES, MIN_ROWS_FOR_ID, MAX_CODE = 12, 36, 20, 20
ID_NAME = re.compile(r"(^|_)(id|key|code|uuid|number|num|nr)$|^id_|(^|_)\w*key$", re.I)
ORDINAL_NAME = re.compile(r"level|rank|grade|score|quintile|stage|priority|frequency|satisf", re.I)
COUNT_NAME = re.compile(r"^n_|count|number_of|nb_|children|visits|parity", re.I)


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str
    role: str = "use"
    reason: str = ""
    n_valid: int = 0
    n_missing: int = 0
    n_unique: int = 0
    categories: tuple[str, ...] = field(default=())


#: Categories that a column may have where they become columns or levels of a model.
MOST_LISTED = 1000


def _is_number(kind) -> bool:
    return isinstance(kind, NumericType)


def _distinct_values(df: DataFrame, fields: list[StructField]) -> DataFrame:
    """variable and n_unique of each column that has a value. Columns of a type are taken together, each value with its
    column's name alone, so that what a task holds of a value is not as wide as the table."""
    out = None
    for kind in dict.fromkeys(f.dataType for f in fields):
        of = [F.struct(F.lit(f.name).alias("variable"), F.col(f"`{f.name}`").alias("value")) for f in fields if f.dataType == kind]
        values = df.select(F.explode(F.array(*of)).alias("v")).select("v.*").where("value is not null").distinct()
        part = values.groupBy("variable").agg(F.count("*").alias("n_unique"))
        out = part if out is None else out.unionByName(part)
    return out


def profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, distinct values, range, whether whole numbers, whether zero occurs."""
    parts, names = [], [f for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    for i, f in enumerate(names):
        c = F.col(f"`{f.name}`")
        n = c.cast("double") if _is_number(f.dataType) else F.lit(None).cast("double")
        parts += [F.count(c).alias(f"n{i}"), F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.bool_and(n == F.floor(n)).alias(f"w{i}"), F.bool_or(n == 0).alias(f"z{i}")]
    one = df.agg(F.count("*").alias("rows"), *parts)
    rows = [
        F.struct(F.lit(f.name).alias("variable"), F.lit(f.dataType.typeName()).alias("type"), F.col("rows"), F.col(f"n{i}").alias("n_valid"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.coalesce(F.col(f"w{i}"), F.lit(False)).alias("whole"), F.coalesce(F.col(f"z{i}"), F.lit(False)).alias("has_zero"))
        for i, f in enumerate(names)
    ]
    each = one.select(F.explode(F.array(*rows)).alias("v")).select("v.*")
    if not names:
        return each
    found = each.join(F.broadcast(_distinct_values(df, names)), "variable", "left")  # a row a column
    return found.select("variable", "type", "rows", "n_valid", F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), "low", "high", "whole", "has_zero")


def with_kinds(profiled: DataFrame, types: dict[str, bool], dates: set[str]) -> DataFrame:
    """profile() with kind, as one CASE. types: whether a column is a number; dates: the date columns."""
    name, n, u = F.col("variable"), F.col("n_valid"), F.col("n_unique")
    share = u / F.nullif(n, F.lit(0))
    listed = lambda names: name.isin(list(names)) if names else F.lit(False)
    number = listed([k for k, v in types.items() if v])
    whole = number & F.col("whole")
    kind = (
        F.when(n == 0, "nominal").when(listed(sorted(dates)), "date")
        .when(listed([k for k in types if ID_NAME.search(k)]) & (share > 0.5), "identifier")
        .when((share > 0.95) & (n >= MIN_ROWS_FOR_ID) & (~number | whole), "identifier")
        .when(u == 1, "nominal").when(u == 2, "binary")
        .when(~number & (share > 0.5) & (u > MANY_CATEGORIES), "text").when(~number, "nominal")
        .when(whole & (u <= MAX_CATEGORIES) & (F.col("low") >= 0) & (F.col("high") <= MAX_CODE), F.when(listed([k for k in types if ORDINAL_NAME.search(k)]), "ordinal").otherwise("nominal"))
        .when(whole & (F.col("low") >= 0) & (F.col("has_zero") | listed([k for k in types if COUNT_NAME.search(k)])), "count")
        .otherwise("continuous")
    )
    role = F.when((n == 0) | (u == 1) | kind.isin("date", "identifier") | (~number & (u > MANY_CATEGORIES)), "ignore").otherwise("use")
    return profiled.withColumn("n_missing", F.col("rows") - n).withColumn("kind", kind).withColumn("role", role)


def infer(df: DataFrame) -> DataFrame:
    """variable, kind, role, n_valid, n_missing, n_unique for each column of plain type."""
    types = {f.name: _is_number(f.dataType) for f in df.schema.fields}
    dates = {f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))}
    return with_kinds(profile(df), types, dates).select("variable", "kind", "role", "n_valid", "n_missing", "n_unique")


def variables(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, Variable]:
    """The catalogue on the driver, one entry a column, with kinds overridden by the user."""
    overrides = overrides or {}
    out = {}
    for r in infer(df).collect():  # a row for each column
        kind = overrides.get(r["variable"], r["kind"])
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        out[r["variable"]] = Variable(r["variable"], kind, "use" if r["variable"] in overrides else r["role"], "user" if r["variable"] in overrides else "", r["n_valid"], r["n_missing"], r["n_unique"])
    return out


def categories(df: DataFrame, column: str, order: list[str] | None = None) -> list[str]:
    """Categories in the user's order, then others in natural order. More than MOST_LISTED are an error: such a column
    names units rather than categories, and its values don't belong on the driver."""
    from statloom.functions.expressions import category_text

    found = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(MOST_LISTED + 1).select(category_text(F.col(column)).alias("c")).collect()
    if len(found) > MOST_LISTED:
        raise ValueError(f"{column} has more than {MOST_LISTED} categories")
    names = [r["c"] for r in found]
    return [c for c in order or [] if c in names] + [c for c in names if c not in (order or [])]
