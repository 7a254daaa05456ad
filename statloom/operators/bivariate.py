"""Tests between two variables: statistics from aggregates, p values on result rows, and the rules that choose a test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import Z_95, d, fisher_z, odds_ratio, ratio
from statloom.operators.describe import shapiro
from statloom.operators.order import adjust_p, quantiles, tie_sum, value_ranks


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n, row and column totals, total, expected of every cell with rows or with both margins."""
    cells = _pairs(df, x, y).groupBy(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy("y").agg(F.sum("n").alias("col_total"))
    every = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("row_total").over(every))
    full = rows.crossJoin(columns).join(cells, ["x", "y"], "left")  # categories by categories, not rows
    expected = d(F.col("row_total")) * d(F.col("col_total")) / d(F.col("total"))
    return full.select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "row_total", "col_total", "total", expected.alias("expected"))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson chi-square without correction, its df, Cramer's V, and the shares that Cochran's rule looks at."""
    cells = crosstab(df, x, y)
    o, e = d(F.col("n")), F.col("expected")
    one = cells.agg(
        F.sum((o - e) * (o - e) / e).alias("chi2"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"), F.max("total").alias("n"),
        F.avg((e < 5).cast("double")).alias("low_share"), F.min(e).alias("min_expected"),
    )
    ok = (F.col("r") >= 2) & (F.col("c") >= 2)
    k = F.least("r", "c") - 1
    return one.select(
        F.when(ok, F.col("chi2")).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), "n",
        F.when(ok, F.sqrt(F.col("chi2") / (d(F.col("n")) * d(k)))).alias("cramer_v"), "low_share", "min_expected",
        ((F.col("low_share") > 0.2) | (F.col("min_expected") < 1)).alias("cochran_fails"),
        (ok & (F.col("r") == 2) & (F.col("c") == 2) & (F.col("min_expected") < 5)).alias("needs_fisher"),
    )


def two_by_two(df: DataFrame, x: str, x_yes: str, y: str, y_yes: str) -> DataFrame:
    """Counts of a 2 x 2 table with odds ratio and Woolf bounds."""
    p = _pairs(df, x, y)
    a, b = F.col(x).cast("string") == x_yes, F.col(y).cast("string") == y_yes
    cell = lambda c: F.count_if(c)
    one = p.agg(cell(a & b).alias("a"), cell(a & ~b).alias("b"), cell(~a & b).alias("c"), cell(~a & ~b).alias("d"))
    value, low, high = odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return one.select("a", "b", "c", "d", value.alias("odds_ratio"), low.alias("low"), high.alias("high"))


def fisher(df: DataFrame, x: str, x_yes: str, y: str, y_yes: str) -> DataFrame:
    return two_by_two(df, x, x_yes, y, y_yes).withColumn("p", dist.p_fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


def monte_carlo_chi_square(df: DataFrame, x: str, y: str, seed: int = 42) -> DataFrame:
    """chi2, replicates, p = (hits + 1) / (b + 1), from tables drawn with the margins seen.

    Drawing tables with fixed margins equals permuting y, so the cost of a replicate does not grow with the rows; the
    replicates are spread over tasks.
    """
    spark = df.sparkSession
    cells = crosstab(df, x, y)
    margins = {}
    for k in ("x", "y"):  # margins have a row for each category
        total = "row_total" if k == "x" else "col_total"
        margins[k] = [r[total] for r in cells.select(k, total).distinct().orderBy(k).collect()]
    rows, columns = np.array(margins["x"]), np.array(margins["y"])
    n = int(rows.sum())
    o, e = d(F.col("n")), F.col("expected")
    seen = cells.agg(F.sum((o - e) * (o - e) / e).alias("chi2")).first()["chi2"]
    b = int(min(10_000, max(1_000, 2e7 / max(n, 1))))
    expected = np.outer(rows, columns) / n

    def draw(batches):
        for batch in batches:
            hits = 0
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                left = columns.copy()
                table = np.empty((len(rows), len(columns)))
                for i in range(len(rows) - 1):
                    table[i] = rng.multivariate_hypergeometric(left, rows[i])
                    left = left - table[i].astype(int)
                table[-1] = left
                hits += float(((table - expected) ** 2 / expected).sum()) >= seen - 1e-9
            yield pd.DataFrame({"hits": [hits]})

    hits = spark.range(b).mapInPandas(draw, "hits long").agg(F.sum("hits").alias("hits"))
    return hits.select(F.lit(seen).alias("chi2"), F.lit(b).alias("replicates"), ((F.col("hits") + 1.0) / F.lit(b + 1.0)).alias("p"))


def somers(df: DataFrame, x_rank: Column, y_rank: Column) -> DataFrame:
    """Somers' d of y given x over two ordinal ranks, from the table's cells: concordant, discordant, d."""
    cells = df.select(x_rank.cast("double").alias("x"), y_rank.cast("double").alias("y")).na.drop().groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, F.col("a.x") < F.col("b.x"))  # cells of a small table
    w = F.col("a.n") * F.col("b.n")
    one = pairs.agg(F.sum(F.when(F.col("a.y") < F.col("b.y"), w).otherwise(0.0)).alias("concordant"), F.sum(F.when(F.col("a.y") > F.col("b.y"), w).otherwise(0.0)).alias("discordant"), F.sum(w).alias("pairs"))
    return one.select("concordant", "discordant", ratio(F.col("concordant") - F.col("discordant"), F.col("pairs")).alias("somers_d"))


def somers_test(df: DataFrame, x_rank: Column, y_rank: Column) -> DataFrame:
    """somers_d of y given x, z and p from the deviation that holds when the true value is zero (tables of a few levels)."""
    cells = df.select(x_rank.cast("double").alias("x"), y_rank.cast("double").alias("y")).na.drop().groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    sides = F.signum((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y"))) * F.col("b.n")
    per = a.join(b, F.col("a.x") != F.col("b.x")).groupBy("a.x", "a.y", "a.n").agg(F.sum(sides).alias("s"), F.sum("b.n").alias("apart"))  # cells of a small table
    n = F.col("n")
    one = per.agg(F.sum(n * F.col("s")).alias("s"), F.sum(n * F.col("apart")).alias("pairs"), F.sum(n * F.col("s") * F.col("s")).alias("ss"), F.sum(n).alias("n"))
    z = ratio(F.col("s"), F.sqrt(4.0 * (F.col("ss") - F.col("s") * F.col("s") / F.col("n"))))
    told = one.select(ratio(F.col("s"), F.col("pairs")).alias("somers_d"), z.alias("z"))
    return told.withColumn("p", dist.p_normal(F.col("z")))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, mean, variance, sd, skewness: what the parametric tests need."""
    x = d(F.col(value))
    return _pairs(df, value, group).groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"))


def group_quantiles(df: DataFrame, value: str, group: str) -> DataFrame:
    x = d(F.col(value))
    p = _pairs(df, value, group).groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    rows = _pairs(df, value, group).select(F.col(group).cast("string").alias("group"), x.alias("x"))
    p = p.join(quantiles(rows, "x", [0.25, 0.5, 0.75], ["group"]).drop("n"), "group")
    return p.select("group", "n", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def welch_t(df: DataFrame, value: str, group: str) -> DataFrame:
    """Welch's t of the first against the second group (by name), its df, Cohen's d with its bounds."""
    g = group_moments(df, value, group)
    one = g.agg(F.sort_array(F.collect_list(F.struct("group", "n", "mean", "variance"))).alias("g"))
    part = lambda k, name: d(F.col("g")[k][name])
    n1, n2, m1, m2, v1, v2 = part(0, "n"), part(1, "n"), part(0, "mean"), part(1, "mean"), part(0, "variance"), part(1, "variance")
    s1, s2 = v1 / n1, v2 / n2
    t, df_ = (m1 - m2) / F.sqrt(s1 + s2), (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1.0) + s2 * s2 / (n2 - 1.0))
    pooled = F.sqrt(((n1 - 1.0) * v1 + (n2 - 1.0) * v2) / (n1 + n2 - 2.0))
    out = one.where(F.size("g") == 2).select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), (m1 - m2).alias("difference"), t.alias("t"), df_.alias("df"), ((m1 - m2) / pooled).alias("cohen_d"))
    se = F.sqrt((d(F.col("n1")) + d(F.col("n2"))) / (d(F.col("n1")) * d(F.col("n2"))) + F.col("cohen_d") * F.col("cohen_d") / (2.0 * (d(F.col("n1")) + d(F.col("n2")))))
    return out.withColumn("d_low", F.col("cohen_d") - Z_95 * se).withColumn("d_high", F.col("cohen_d") + Z_95 * se)


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F, its dfs, eta squared and omega squared (not below zero)."""
    g = group_moments(df, value, group)
    grand = F.sum(d(F.col("n")) * F.col("mean")) / F.sum(d(F.col("n")))
    n, m = d(F.col("n")), F.col("mean")
    one = g.agg(F.count("*").cast("double").alias("k"), F.sum(n).alias("n"), (F.sum(n * m * m) - grand * F.sum(n * m)).alias("ssb"), F.sum((n - 1.0) * F.coalesce("variance", F.lit(0.0))).alias("ssw"))
    k, total = F.col("k"), F.col("n")
    msw = F.col("ssw") / (total - k)
    return one.select(
        (k - 1.0).alias("df1"), (total - k).alias("df2"), (F.col("ssb") / (k - 1.0) / msw).alias("f"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"),
        F.greatest(F.lit(0.0), (F.col("ssb") - (k - 1.0) * msw) / (F.col("ssb") + F.col("ssw") + msw)).alias("omega2"),
    )


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """Welch's F for unequal variances, its dfs and omega squared."""
    g = group_moments(df, value, group).where("n > 1 and variance > 0")
    every = Window.partitionBy()
    w = d(F.col("n")) / F.col("variance")
    g = g.withColumn("w", w).withColumn("ws", F.sum("w").over(every)).withColumn("grand", F.sum(F.col("w") * F.col("mean")).over(every) / F.col("ws"))
    part = 1.0 - F.col("w") / F.col("ws")
    one = g.agg(F.count("*").cast("double").alias("k"), F.sum(d(F.col("n"))).alias("n"), F.sum(F.col("w") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("a"), F.sum(part * part / (d(F.col("n")) - 1.0)).alias("l"))
    k = F.col("k")
    f = F.col("a") / (k - 1.0) / (1.0 + 2.0 * (k - 2.0) / (k * k - 1.0) * F.col("l"))
    one = one.withColumn("f", f)
    return one.select((k - 1.0).alias("df1"), ((k * k - 1.0) / (3.0 * F.col("l"))).alias("df2"), "f", F.greatest(F.lit(0.0), (k - 1.0) * (F.col("f") - 1.0) / ((k - 1.0) * (F.col("f") - 1.0) + F.col("n"))).alias("omega2"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's test centred on the medians: an analysis of variance of the distances to them."""
    p = _pairs(df, value, group).select(F.col(group).cast("string").alias("group"), d(F.col(value)).alias("x"))
    medians = quantiles(p, "x", [0.5], ["group"]).select("group", F.col("q")[0].alias("median"))
    away = p.join(medians, "group").select("group", F.abs(F.col("x") - F.col("median")).alias("away"))
    return anova(away, "away", "group").select("df1", "df2", F.col("f").alias("w"))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, rank_sum of the average ranks of value over all groups."""
    rows = _pairs(df, value, group).select(F.col(group).cast("string").alias("group"), d(F.col(value)).alias("value"))
    counted = rows.groupBy("group", "value").agg(F.count("*").alias("n"))  # counts meet the ranks, not rows
    ranked = counted.join(value_ranks(rows, "value").select("value", "rank_avg"), "value")
    return ranked.groupBy("group").agg(F.sum("n").alias("n"), F.sum(d(F.col("n")) * F.col("rank_avg")).alias("rank_sum"))


def _ties(df: DataFrame, value: str, group: str) -> DataFrame:
    return value_ranks(_pairs(df, value, group).select(d(F.col(value)).alias("x")), "x").agg(F.coalesce(tie_sum(), F.lit(0.0)).alias("ties"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group (by name), z with tie and continuity correction, rank-biserial effect."""
    one = rank_sums(df, value, group).agg(F.sort_array(F.collect_list(F.struct("group", "n", "rank_sum"))).alias("g")).where(F.size("g") == 2)
    one = one.crossJoin(_ties(df, value, group))  # one row each
    n1, n2 = d(F.col("g")[0]["n"]), d(F.col("g")[1]["n"])
    u = F.col("g")[0]["rank_sum"] - n1 * (n1 + 1.0) / 2.0
    one = one.select(n1.alias("n1"), n2.alias("n2"), u.alias("u"), "ties")
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1.0 - F.col("ties") / (n * (n - 1.0))))
    away = F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0)
    return one.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", (F.greatest(F.lit(0.0), away - 0.5) / sd).alias("z"), (-(1.0 - 2.0 * F.col("u") / (F.col("n1") * F.col("n2")))).alias("effect"))


#: Rows of the smaller group up to which U's exact distribution is used, where no values are tied.
EXACT_ROWS = 8


def mann_whitney_p(df: DataFrame, value: str, group: str) -> DataFrame:
    """mann_whitney() with p and exact: the exact p where a group has at most EXACT_ROWS rows and no values are tied, else
    that of z."""
    one = mann_whitney(df, value, group).crossJoin(_ties(df, value, group))  # one row each
    exact = (F.least("n1", "n2") <= EXACT_ROWS) & (F.col("ties") == 0)
    asked = [F.when(exact, F.col(c)) for c in ("n1", "n2", "u")]
    return one.withColumn("exact", exact).withColumn("p", F.coalesce(dist.p_mann_whitney(*asked), dist.p_normal(F.col("z")))).drop("ties")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected H, its df, epsilon squared."""
    sums = rank_sums(df, value, group)
    one = sums.agg(F.count("*").cast("double").alias("k"), F.sum(d(F.col("n"))).alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / d(F.col("n"))).alias("s")).crossJoin(_ties(df, value, group))
    n = F.col("n")
    h = (12.0 / (n * (n + 1.0)) * F.col("s") - 3.0 * (n + 1.0)) / (1.0 - F.col("ties") / (n * n * n - n))
    one = one.withColumn("h", h)
    return one.select("h", (F.col("k") - 1.0).alias("df"), (F.col("h") / ((n * n - 1.0) / (n + 1.0))).alias("epsilon2"))


def dunn(df: DataFrame, value: str, group: str) -> DataFrame:
    """Pairs of groups with Dunn's z under tie-corrected variance, its p and Holm's p over the pairs."""
    sums = rank_sums(df, value, group).select("group", d(F.col("n")).alias("n"), (F.col("rank_sum") / d(F.col("n"))).alias("mean_rank"))
    total = sums.agg(F.sum("n").alias("total")).crossJoin(_ties(df, value, group))
    a, b = sums.alias("a"), sums.alias("b")
    pairs = a.join(b, F.col("a.group") < F.col("b.group")).crossJoin(F.broadcast(total))  # groups, not rows
    n = F.col("total")
    variance = (n * (n + 1.0) / 12.0 - F.col("ties") / (12.0 * (n - 1.0))) * (1.0 / F.col("a.n") + 1.0 / F.col("b.n"))
    told = pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), ((F.col("a.mean_rank") - F.col("b.mean_rank")) / F.sqrt(variance)).alias("z"))
    told = told.withColumn("p", dist.p_normal(F.col("z"))).withColumn("pair", F.concat_ws("/", "a", "b"))
    return adjust_p(told, "p", "pair").drop("pair", "p_bh")


def _moment_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    g = group_moments(df, value, group).select("group", d(F.col("n")).alias("n"), "mean", "variance")
    return g.alias("a").join(g.alias("b"), F.col("a.group") < F.col("b.group"))  # groups, not rows


def games_howell(df: DataFrame, value: str, group: str) -> DataFrame:
    """Pairs of groups: difference, studentized q, Welch df and p."""
    k = group_moments(df, value, group).agg(F.count("*").alias("k"))
    sa, sb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    gap = F.col("a.mean") - F.col("b.mean")
    pairs = _moment_pairs(df, value, group).select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), gap.alias("difference"), (F.abs(gap) / F.sqrt((sa + sb) / 2.0)).alias("q"), ((sa + sb) * (sa + sb) / (sa * sa / (F.col("a.n") - 1.0) + sb * sb / (F.col("b.n") - 1.0))).alias("df"))
    return pairs.crossJoin(F.broadcast(k)).withColumn("p", dist.p_studentized_range(F.col("q"), F.col("k"), F.col("df"))).drop("k")


def tukey_kramer(df: DataFrame, value: str, group: str) -> DataFrame:
    """Pairs of groups: difference, studentized q under the common variance, df and p."""
    g = group_moments(df, value, group)
    pooled = g.agg(F.count("*").alias("k"), (F.sum(d(F.col("n"))) - d(F.count("*"))).alias("df"), (F.sum((d(F.col("n")) - 1.0) * F.col("variance")) / (F.sum(d(F.col("n"))) - d(F.count("*")))).alias("msw"))
    pairs = _moment_pairs(df, value, group).crossJoin(F.broadcast(pooled))
    gap = F.col("a.mean") - F.col("b.mean")
    out = pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), gap.alias("difference"), (F.abs(gap) / F.sqrt(F.col("msw") / 2.0 * (1.0 / F.col("a.n") + 1.0 / F.col("b.n")))).alias("q"), "df", "k")
    return out.withColumn("p", dist.p_studentized_range(F.col("q"), F.col("k"), F.col("df"))).drop("k")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, Pearson's r with Fisher bounds and Spearman's rho; null below four rows or without variation."""
    p = _pairs(df, x, y).select(d(F.col(x)).alias("x"), d(F.col(y)).alias("y"))
    cells = p.groupBy("x", "y").agg(F.count("*").alias("w"))
    rank = lambda c: value_ranks(p, c).select(F.col("value").alias(c), F.col("rank_avg").alias(f"r{c}"))
    moments = p.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    ranked = cells.join(rank("x"), "x").join(rank("y"), "y").crossJoin(F.broadcast(moments))  # one row
    middle, w = (d(F.col("n")) + 1.0) / 2.0, d(F.col("w"))
    a, b = F.col("rx") - middle, F.col("ry") - middle
    spread = F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
    one = ranked.groupBy("n", "r").agg(F.try_divide(F.sum(w * a * b), spread).alias("rho"))
    ok = F.col("n") >= 4
    one = one.select("n", F.when(ok & ~F.isnan("r"), F.col("r")).alias("r"), F.when(ok & ~F.isnan("rho"), F.col("rho")).alias("rho"))
    low, high = fisher_z(F.col("r"), F.col("n"))
    return one.select("n", "r", low.alias("r_low"), high.alias("r_high"), "rho")


#: Rows below which a group's shape is tested by Shapiro-Wilk, and the largest skewness above it.
SMALL_GROUP, MOST_SKEW = 30, 1.0


def near_normal(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, ok: below 3 rows no; from 30 on by skewness; between them by Shapiro-Wilk at 5 %."""
    g = group_moments(df, value, group)
    rows = _pairs(df, value, group).select(F.col(group).cast("string").alias("group"), d(F.col(value)).alias("x"))
    tested = shapiro(rows, "x", ["group"], 3, SMALL_GROUP - 1).select("group", "p")
    ok = F.when(F.col("n") < 3, False).when(F.col("n") >= SMALL_GROUP, F.abs("skewness") <= MOST_SKEW).otherwise(F.coalesce(F.col("p") >= 0.05, F.lit(False)))
    return g.join(tested, "group", "left").select("group", "n", F.coalesce(ok, F.lit(False)).alias("ok"))


def compare_groups(df: DataFrame, value: str, group: str, nonparametric: bool = False) -> DataFrame:
    """The chosen test of a number across groups: variable, test, n_groups, statistic, df1, df2, p, effect, effect_name."""
    normal = near_normal(df, value, group).agg(F.count("*").alias("k"), F.bool_and("ok").alias("ok")).first()
    k, ok = normal["k"], bool(normal["ok"]) and not nonparametric
    none = F.lit(None).cast("double")

    def row(frame: DataFrame, test: str, statistic: Column, df1: Column, df2: Column, p: Column, effect: Column, name: str) -> DataFrame:
        return frame.select(F.lit(value).alias("variable"), F.lit(test).alias("test"), F.lit(k).alias("n_groups"), statistic.alias("statistic"), df1.alias("df1"), df2.alias("df2"), p.alias("p"), effect.alias("effect"), F.lit(name).alias("effect_name"))

    if k < 2:
        empty = df.sparkSession.range(1)
        return row(empty, "not computable", none, none, none, none, none, "none")
    if k == 2:
        if ok:
            f = welch_t(df, value, group)
            return row(f, "Welch t", F.col("t"), F.col("df"), none, dist.p_t(F.col("t"), F.col("df")), F.col("cohen_d"), "Cohen d")
        f = mann_whitney_p(df, value, group)
        return row(f, "Mann-Whitney", F.col("u"), none, none, F.col("p"), F.col("effect"), "rank-biserial")
    if ok:
        spread = levene(df, value, group)
        equal = spread.select(dist.p_f(F.col("w"), F.col("df1"), F.col("df2")).alias("p")).first()["p"]
        f, name = (anova(df, value, group), "ANOVA") if equal is None or equal >= 0.05 else (welch_anova(df, value, group), "Welch ANOVA")
        return row(f, name, F.col("f"), F.col("df1"), F.col("df2"), dist.p_f(F.col("f"), F.col("df1"), F.col("df2")), F.col("omega2"), "omega squared")
    f = kruskal(df, value, group)
    return row(f, "Kruskal-Wallis", F.col("h"), F.col("df"), none, dist.p_chi2(F.col("h"), F.col("df")), F.col("epsilon2"), "epsilon squared")


def place(column: str, order: list[str]) -> Column:
    """The place of a category in its order, from 1; null where it isn't there."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in order]), F.col(column).cast("string")), F.lit(0))


def compare_categories(df: DataFrame, x: str, y: str, x_order: list[str] | None = None, y_order: list[str] | None = None) -> DataFrame:
    """The chosen test between two categorical variables, in the columns of compare_groups(). With an order of both,
    Somers' d and its p replace the test and its p."""
    c = chi_square(df, x, y).first()
    none = F.lit(None).cast("double")
    base = chi_square(df, x, y)
    if c is None or c["chi2"] is None:
        return base.select(F.lit(x).alias("variable"), F.lit("not computable").alias("test"), F.lit(0).alias("n_groups"), none.alias("statistic"), none.alias("df1"), none.alias("df2"), none.alias("p"), none.alias("effect"), F.lit("none").alias("effect_name"))
    if x_order and y_order:
        told = somers_test(df, place(x, x_order), place(y, y_order))
        return told.select(F.lit(x).alias("variable"), F.lit("Somers").alias("test"), F.lit(c["df"] + 1).cast("int").alias("n_groups"), F.col("z").alias("statistic"), none.alias("df1"), none.alias("df2"), "p", F.col("somers_d").alias("effect"), F.lit("Somers d").alias("effect_name"))
    if c["needs_fisher"]:
        levels = [r["x"] for r in crosstab(df, x, y).select("x").distinct().orderBy("x").collect()]
        answers = [r["y"] for r in crosstab(df, x, y).select("y").distinct().orderBy("y").collect()]
        p, test = fisher(df, x, levels[0], y, answers[0]).select("p"), "Fisher"
    elif c["cochran_fails"]:
        p, test = monte_carlo_chi_square(df, x, y).select("p"), "Monte Carlo chi-square"
    else:
        p, test = base.select(dist.p_chi2(F.col("chi2"), F.col("df")).alias("p")), "chi-square"
    return base.crossJoin(p).select(F.lit(x).alias("variable"), F.lit(test).alias("test"), (F.col("df") + 1).cast("int").alias("n_groups"), F.col("chi2").alias("statistic"), d(F.col("df")).alias("df1"), none.alias("df2"), "p", F.col("cramer_v").alias("effect"), F.lit("Cramer V").alias("effect_name"))


def compare_numbers(df: DataFrame, x: str, y: str, nonparametric: bool = False) -> DataFrame:
    """Pearson's or Spearman's correlation, by the shapes of both, in the columns of compare_groups()."""
    both = _pairs(df, x, y)
    one = both.select(F.lit("all").alias("group"), d(F.col(x)).alias("x"), d(F.col(y)).alias("y"))
    pearson = not nonparametric and all(near_normal(one, c, "group").agg(F.bool_and("ok").alias("ok")).first()["ok"] or False for c in ("x", "y"))
    c = correlation(df, x, y)
    r = F.col("r" if pearson else "rho")
    t = r * F.sqrt((d(F.col("n")) - 2.0) / F.greatest(F.lit(1e-12), 1.0 - r * r))
    none = F.lit(None).cast("double")
    return c.select(F.lit(x).alias("variable"), F.lit("Pearson" if pearson else "Spearman").alias("test"), F.lit(0).alias("n_groups"), r.alias("statistic"), (d(F.col("n")) - 2.0).alias("df1"), none.alias("df2"), dist.p_t(t, F.col("n") - 2).alias("p"), r.alias("effect"), F.lit("r" if pearson else "rho").alias("effect_name"))


#: Which comparison of pairs follows a test across three groups or more.
POST_HOC = {"Kruskal-Wallis": "Dunn", "Welch ANOVA": "Games-Howell", "ANOVA": "Tukey-Kramer"}


def post_hoc(df: DataFrame, value: str, group: str, test: str) -> DataFrame | None:
    """test, a, b, statistic, p of the pairs of groups, by the test that found them different; None if none follows it."""
    if test not in POST_HOC:
        return None
    if test == "Kruskal-Wallis":
        pairs = dunn(df, value, group).select("a", "b", F.col("z").alias("statistic"), F.col("p_holm").alias("p"))
    else:
        pairs = (games_howell if test == "Welch ANOVA" else tukey_kramer)(df, value, group).select("a", "b", F.col("q").alias("statistic"), "p")
    return pairs.select(F.lit(POST_HOC[test]).alias("test"), "a", "b", "statistic", "p")
