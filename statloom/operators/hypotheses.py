"""Declared hypotheses against the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import fold, tokens

POSITIVE = r"\b(increase|increases|raise|raises|more|higher|positive|positively|favou?rs?|improve|improves|promote|promotes)\b"
NEGATIVE = r"\b(decrease|decreases|reduce|reduces|less|lower|negative|negatively|hinder|hinders|worsen|worsens)\b"
LEAST_SCORE = 0.34


def guess(hypotheses: DataFrame, variables: DataFrame) -> DataFrame:
    """id, text, variable, direction: the variable whose label shares most words with the text, and the stated sign.

    hypotheses: id, text; variables: variable, label. Words meet in an equality join; a score below 0.34 names none.
    """
    h = hypotheses.select("id", "text", tokens(F.col("text")).alias("words"))
    v = variables.select("variable", F.array_distinct(tokens(F.col("label"))).alias("label_words"))
    shared = h.select("id", F.explode("words").alias("w")).join(v.select("variable", F.size("label_words").alias("n"), F.explode("label_words").alias("w")), "w")
    scored = shared.groupBy("id", "variable", "n").agg(F.count("*").alias("overlap")).withColumn("score", F.col("overlap") / F.col("n").cast("double") + 0.01 * F.col("overlap"))
    best = scored.where(F.col("score") >= LEAST_SCORE).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "variable"))).where("rank = 1")
    direction = F.when(fold(F.col("text")).rlike(POSITIVE), 1).when(fold(F.col("text")).rlike(NEGATIVE), -1)
    return h.join(best.select("id", "variable", "score"), "id", "left").select("id", "text", "variable", "score", direction.alias("direction"))


def verdicts(declared: DataFrame, tests: DataFrame, terms: DataFrame, alpha: float = 0.05) -> DataFrame:
    """id, variable, verdict from bivariate tests (variable, p) and model terms (variable, term, estimate, p).

    The model decides where it has the variable. Confirmed: a significant effect of the stated sign, if one is stated;
    partly: only some levels; contradicted: the other sign; not confirmed: no significant effect; else not verifiable.
    """
    per = terms.groupBy("variable").agg(F.count("*").alias("levels"), F.count_if(F.col("p") < alpha).alias("significant"), F.count_if((F.col("p") < alpha) & (F.col("estimate") > 0)).alias("up"), F.count_if((F.col("p") < alpha) & (F.col("estimate") < 0)).alias("down"))
    joined = declared.join(tests.select("variable", F.col("p").alias("p_bivariate")), "variable", "left").join(per, "variable", "left")
    agree = F.when(F.col("direction") == 1, F.col("up")).when(F.col("direction") == -1, F.col("down")).otherwise(F.col("significant"))
    by_model = F.when(F.col("significant") == 0, "not confirmed").when(agree == 0, "contradicted").when(agree < F.col("levels"), "partly confirmed").otherwise("confirmed")
    by_test = F.when(F.col("p_bivariate") < alpha, F.when(F.col("direction").isNull(), "confirmed").otherwise("partly confirmed")).otherwise("not confirmed")
    verdict = F.when(F.col("variable").isNull(), "not verifiable").when(F.col("levels").isNotNull(), by_model).when(F.col("p_bivariate").isNotNull(), by_test).otherwise("not verifiable")
    return joined.select("id", "variable", "direction", verdict.alias("verdict"))
