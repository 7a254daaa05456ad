"""Data quality: missing values, outliers, rare categories, duplicates, missingness against an outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import d, ratio
from statloom.operators.bivariate import chi_square, crosstab, mann_whitney_p
from statloom.operators.order import quantiles

MISSING_LIMIT, RARE = 0.05, 5
#: Rows with and without a value that a comparison of an outcome's numbers needs.
LEAST_ROWS = 5


def missing(df: DataFrame) -> DataFrame:
    """variable, n_missing, rate, flagged (above 5 %)."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns])).alias("v")
    rate = ratio(F.col("n_missing"), F.col("rows"))
    return one.select("rows", rows).select("rows", "v.*").select("variable", "n_missing", rate.alias("rate"), (rate > MISSING_LIMIT).alias("flagged"))


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, extreme (beyond 3 interquartile ranges), mild (beyond 1.5, not extreme), for at least four values."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), d(F.col(c)).alias("x")) for c in columns])).alias("v")).select("v.*").where("x is not null")
    q = quantiles(rows, "x", [0.25, 0.75], ["variable"]).where("n >= 4")
    q = q.select("variable", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    away = F.greatest(F.col("q1") - F.col("x"), F.col("x") - F.col("q3"))
    joined = rows.join(F.broadcast(q), "variable")  # a row for each column
    return joined.groupBy("variable", "n").agg(F.count_if(away > 3.0 * F.col("iqr")).alias("extreme"), F.count_if((away > 1.5 * F.col("iqr")) & ~(away > 3.0 * F.col("iqr"))).alias("mild"))


def rare_categories(df: DataFrame, columns: list[str], below: int = RARE) -> DataFrame:
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in columns])).alias("v")).select("v.*").where("category is not null")
    return rows.groupBy("variable", "category").agg(F.count("*").alias("n")).where(F.col("n") < below)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, and duplicates: rows beyond the first of each group that agrees in all columns, nulls included."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def missingness_by_outcome(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """2 x 2 counts of a column's missingness against a binary outcome, with Yates's chi-square."""
    valid = df.where(F.col(outcome).isNotNull()).select(F.col(column).isNull().alias("m"), F.col(outcome).cast("string").alias("y"))
    first = valid.agg(F.min("y").alias("first"))
    p = valid.crossJoin(F.broadcast(first))  # one row
    yes = F.col("y") == F.col("first")
    one = p.agg(F.count_if(F.col("m") & yes).alias("a"), F.count_if(F.col("m") & ~yes).alias("b"), F.count_if(~F.col("m") & yes).alias("c"), F.count_if(~F.col("m") & ~yes).alias("d"))
    a, b, c, e = (d(F.col(k)) for k in "abcd")
    n = a + b + c + e
    gap = F.greatest(F.lit(0.0), F.abs(a * e - b * c) - n / 2.0)
    return one.select("a", "b", "c", "d", ratio(n * gap * gap, (a + b) * (c + e) * (a + c) * (b + e)).alias("chi2"))


def missingness_tests(df: DataFrame, outcome: str, numeric: bool, columns: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """variable, rate, test, statistic, p, related: whether an outcome differs where a column has no value.

    Columns with more than MISSING_LIMIT of their values missing are tested: a numeric outcome by Mann-Whitney's U of the
    rows without a value, if LEAST_ROWS rows are in both groups; categories by chi-square, with Yates's correction in
    tables of two by two. A column that isn't missing in any row with an outcome, or in all, has no test.
    """
    schema = "variable string, rate double, test string, statistic double, p double, related boolean"
    listed = columns or [c for c in df.columns if c != outcome]
    rates = {r["variable"]: r["rate"] for r in missing(df.select(*[F.col(f"`{c}`") for c in listed])).where("flagged").collect()}  # a row for each column
    parts = []
    for name in [c for c in listed if c in rates]:
        rows = df.where(F.col(f"`{outcome}`").isNotNull()).select(F.col(f"`{outcome}`").alias("y"), F.when(F.col(f"`{name}`").isNull(), "a missing").otherwise("b known").alias("m"))
        if numeric:
            one = mann_whitney_p(rows, "y", "m").where((F.col("n1") >= LEAST_ROWS) & (F.col("n2") >= LEAST_ROWS))
            told = one.select(F.lit("Mann-Whitney").alias("test"), F.col("u").alias("statistic"), "p")
        else:
            gap = F.abs(d(F.col("n")) - F.col("expected"))
            yates = crosstab(rows, "m", "y").agg(F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) / F.col("expected")).alias("corrected"))
            one = chi_square(rows, "m", "y").where("chi2 is not null").crossJoin(yates)  # one row each
            statistic = F.when(F.col("df") == 1, F.col("corrected")).otherwise(F.col("chi2"))
            told = one.select(F.lit("chi-square").alias("test"), statistic.alias("statistic"), "df").withColumn("p", dist.p_chi2(F.col("statistic"), F.col("df"))).drop("df")
        parts.append(told.select(F.lit(name).alias("variable"), F.lit(rates[name]).alias("rate"), "test", "statistic", "p", (F.col("p") < alpha).alias("related")))
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
