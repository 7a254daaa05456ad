"""Checks of written text against the facts and sources it may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import citations, fold, is_causal, is_injection, number_decimals, number_texts, number_value

FREE_INTEGERS, FIRST_YEAR, LAST_YEAR = 10, 1900, 2100


def quoted_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, value, decimals of every number in the texts."""
    found = texts.select(key, F.explode(number_texts(F.col(text))).alias("v"))
    return found.select(key, number_value(F.col("v")).alias("value"), F.coalesce(number_decimals(F.col("v")), F.lit(0)).alias("decimals")).where("value is not null")


def unsupported_numbers(quoted: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Numbers that no allowed value rounds to. Small whole numbers are free; years must be listed.

    A band anti join as an equality join: both sides are put in cells of the quoted precision, and a fact is in the two
    cells beside its own as well. So the texts, the longer side, are read once and their numbers stay single rows.
    """
    v, dec = F.col("value"), F.col("decimals")
    whole = (dec == 0) & (v == F.floor(v))
    year = whole & v.between(FIRST_YEAR, LAST_YEAR)
    scale = F.pow(F.lit(10.0), dec)
    need = quoted.where(~(whole & (F.abs(v) <= FREE_INTEGERS)) | year).withColumn("cell", F.round(v * scale))
    facts = allowed.select(F.col("fact").cast("double").alias("fact")).distinct().withColumn("decimals", F.explode(F.sequence(F.lit(0), F.lit(6))))
    facts = facts.withColumn("cell", F.explode(F.array(*[F.round(F.col("fact") * F.pow(F.lit(10.0), F.col("decimals"))) + k for k in (-1, 0, 1)])))
    close = F.abs(need["value"] - facts["fact"]) <= 0.5 / F.pow(F.lit(10.0), need["decimals"]) + 1e-9
    exact = need["value"] == facts["fact"]
    rounded = (F.abs(need["value"]) >= 10) & (need["value"] == F.round(facts["fact"]))
    is_year = (need["decimals"] == 0) & need["value"].between(FIRST_YEAR, LAST_YEAR)
    ok = F.when(is_year, exact).when(need["decimals"] == 0, exact | rounded).otherwise(close)
    return need.join(facts, (need["cell"] == facts["cell"]) & (need["decimals"] == facts["decimals"]) & ok, "left_anti").drop("cell").select(key, "value", "decimals")


def unknown_citations(texts: DataFrame, key: str, text: str, bibliography: DataFrame) -> DataFrame:
    """Citations (key, name, year) that the bibliography (name, year) does not hold; accents and case do not matter."""
    found = texts.select(key, F.explode(citations(F.col(text))).alias("c")).select(key, F.col("c.name").alias("name"), F.col("c.year").alias("year"), fold(F.col("c.name")).alias("_name"))
    known = bibliography.select(fold(F.col("name")).alias("_name"), F.col("year").cast("string").alias("year")).distinct()
    return found.join(known, ["_name", "year"], "left_anti").select(key, "name", "year")


def flags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, causal, injection."""
    return texts.select(key, is_causal(F.col(text)).alias("causal"), is_injection(F.col(text)).alias("injection"))


def glossary_terms(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, term for glossary terms (one word each or several) in the texts: candidates by words, then the whole term."""
    words = texts.select(key, fold(F.col(text)).alias("_text")).withColumn("first", F.explode(F.array_distinct(F.split("_text", "[^a-z0-9]+"))))
    listed = terms.select("term", fold(F.col("term")).alias("_term")).withColumn("first", F.split("_term", "[^a-z0-9]+")[0])
    hit = F.contains(F.concat(F.lit(" "), F.regexp_replace("_text", "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace("_term", "[^a-z0-9]+", " "), F.lit(" ")))
    return words.join(listed, "first").where(hit).select(key, "term").distinct()
