"""Descriptive statistics: weighted frequencies with intervals, moments, quantiles, normality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import d, ratio, wilson
from statloom.operators.order import quantiles, running_sums


def frequencies(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """category, n, weighted, share and Wilson bounds over valid answers.

    With a weight, shares are weighted (null weights count as zero) and the interval uses Kish's effective number.
    """
    valid = df.where(F.col(column).isNotNull())
    w = F.coalesce(d(F.col(weight)), F.lit(0.0)) if weight else F.lit(1.0)
    per = valid.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"), F.sum(w).alias("weighted"), F.sum(w * w).alias("_ww"))
    every = Window.partitionBy()
    total, squares = F.sum("weighted").over(every), F.sum("_ww").over(every)
    per = per.withColumn("share", ratio(F.col("weighted"), total)).withColumn("n_effective", ratio(total * total, squares))
    low, high = wilson(F.col("share"), F.col("n_effective"))
    return per.select("category", "n", "weighted", "share", "n_effective", low.alias("low"), high.alias("high"))


def quantitative(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """variable, n, mean, sd, min, max, quartiles, skewness and excess kurtosis (population form). Rows
    whose `by` is null are left out where there is one."""
    by = by or []
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), d(F.col(c)).alias("x")) for c in columns])).alias("v")).select(*by, "v.*").where("x is not null")
    q = quantiles(rows, "x", [0.25, 0.5, 0.75], [*by, "variable"]).drop("n")
    moments = rows.groupBy(*by, "variable").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurtosis"),
    )
    return moments.join(q, [*by, "variable"]).select(*by, "variable", "n", "mean", "sd", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max",
             F.when(F.col("n") > 2, F.col("skew")).alias("skewness"), F.when(F.col("n") > 3, F.col("kurtosis")).alias("kurtosis"))


def weighted_mean(df: DataFrame, column: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and deviation: variance sum w (x - m)^2 / sum w, times sum w / (sum w - 1)."""
    by = by or []
    x, w = d(F.col(column)), F.coalesce(d(F.col(weight)), F.lit(0.0))
    sums = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    mean = ratio(F.col("swx"), F.col("sw"))
    variance = (F.col("swxx") / F.col("sw") - mean * mean) * F.col("sw") / F.nullif(F.col("sw") - 1.0, F.lit(0.0))
    return sums.select(*by, "n", F.col("sw").alias("weight"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("sd"))


def dagostino(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """D'Agostino-Pearson omnibus test: n, z of skewness and kurtosis, k2 and its p, exp(-k2 / 2)."""
    by = by or []
    m = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.skewness(d(F.col(column))).alias("g1"), (F.kurtosis(d(F.col(column))) + 3.0).alias("b2")).where("n >= 20")
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1.0
    delta, alpha = 1.0 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2.0 / (w2 - 1))
    m = m.withColumn("z_skew", delta * F.asinh(y / alpha))
    mean = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b2") - mean) / F.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1.0 + 4.0 / (root * root)))
    inner = (1.0 - 2.0 / a) / (1.0 + x * F.sqrt(2.0 / (a - 4.0)))
    z_kurt = (1.0 - 2.0 / (9.0 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1.0 / 3))) / F.sqrt(2.0 / (9.0 * a))
    m = m.withColumn("z_kurt", z_kurt).withColumn("k2", F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt"))
    return m.select(*by, F.col("n").cast("long").alias("n"), "z_skew", "z_kurt", "k2", F.exp(-F.col("k2") / 2.0).alias("p"))


#: Values from which on Shapiro-Wilk's approximation isn't used.
MOST_SHAPIRO = 5000


def shapiro(df: DataFrame, column: str, by: list[str] | None = None, least: int = 3, most: int = MOST_SHAPIRO) -> DataFrame:
    """Shapiro-Wilk by group: n, w, p of the groups with least to most valid values that aren't all equal. Rows whose `by`
    is null are left out.

    Distinct values get their places from counts, so no task gathers a group; a place's weight is an expression of the
    place and n alone, and a value that takes several places is weighed by each of them.
    """
    by = by or []
    rows = df.na.drop(subset=[column, *by]).select(*by, d(F.col(column)).alias("_x")).where(~F.isnan("_x"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), (F.var_pop("_x") * F.count("*")).alias("_ss"), (F.min("_x") < F.max("_x")).alias("_spread")).where(F.col("_n").between(least, most) & F.col("_spread"))
    told = groups.select(*by, "_n", "_ss")
    counted = rows.groupBy(*by, "_x").agg(F.count("*").alias("_ties"))
    counted = counted.join(told, by) if by else counted.crossJoin(F.broadcast(told))  # one row without groups
    placed = running_sums(counted, "_x", {"_ties": "_before"}, by).withColumn("_i", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_ties"))))
    n = d(F.col("_n"))
    m = dist.normal_quantile((d(F.col("_i")) - 0.375) / (n + 0.25))
    last = lambda c, back=0: F.max(F.when(F.col("_i") == F.col("_n") - back, F.col(c)))
    first = lambda i: F.max(F.when(F.col("_i") == i, F.col("_x")))
    sums = [F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.sum(F.col("_m") * F.col("_x")).alias("_mx"), (last("_x") - first(1)).alias("_outer"), (last("_x", 1) - first(2)).alias("_inner"), last("_m").alias("_high"), last("_m", 1).alias("_second")]
    one = placed.withColumn("_m", m).groupBy(*by, "_n", "_ss").agg(*sums)
    high, second = F.col("_high"), F.col("_second")
    u, mm, outer, inner = 1.0 / F.sqrt(n), F.col("_mm"), F.col("_outer"), F.col("_inner")

    def power(*coefficients: float) -> Column:
        """A polynomial of u without constant term, lowest power first."""
        total = F.lit(0.0)
        for c in coefficients[::-1]:
            total = (total + F.lit(c)) * u
        return total

    weights = {"_a1": high / F.sqrt(mm) + power(0.221157, -0.147981, -2.07119, 4.434685, -2.706056), "_a2": second / F.sqrt(mm) + power(0.042981, -0.293762, -1.752461, 5.682633, -3.582633)}
    one, a1, a2 = one.withColumns(weights), F.col("_a1"), F.col("_a2")
    few = a1 * outer + (F.col("_mx") - high * outer) / F.sqrt((mm - 2.0 * high * high) / (1.0 - 2.0 * a1 * a1))
    many = a1 * outer + a2 * inner + (F.col("_mx") - high * outer - second * inner) / F.sqrt((mm - 2.0 * high * high - 2.0 * second * second) / (1.0 - 2.0 * a1 * a1 - 2.0 * a2 * a2))
    top = F.when(F.col("_n") == 3, F.sqrt(F.lit(0.5)) * outer).when(F.col("_n") <= 5, few).otherwise(many)
    w = F.least(F.lit(1.0), top * top / F.col("_ss"))
    return one.select(*by, F.col("_n").alias("n"), w.alias("w")).withColumn("p", dist.p_shapiro(F.col("w"), F.col("n")))


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, test, statistic, p: Shapiro-Wilk up to MOST_SHAPIRO values, D'Agostino-Pearson above. Columns with
    fewer than three values or one value only have no row."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), d(F.col(c)).alias("x")) for c in columns])).alias("v")).select("v.*").where("x is not null")
    small = shapiro(rows, "x", ["variable"]).select("variable", "n", F.lit("Shapiro-Wilk").alias("test"), F.col("w").alias("statistic"), "p")
    spread = rows.groupBy("variable").agg((F.min("x") < F.max("x")).alias("spread")).where("spread").select("variable")
    large = dagostino(rows, "x", ["variable"]).join(spread, "variable").where(F.col("n") > MOST_SHAPIRO).select("variable", "n", F.lit("D'Agostino-Pearson").alias("test"), F.col("k2").alias("statistic"), "p")
    return small.unionByName(large.where(F.col("statistic").isNotNull() & ~F.isnan("statistic") & ~F.isnan("p")))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, low, high, n. The number of bins is the larger of the Sturges and Freedman-Diaconis ones."""
    x = d(F.col(column))
    valid = df.where(F.col(column).isNotNull()).select(x.alias("x"))
    s = valid.agg(F.count("*").cast("double").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).crossJoin(F.broadcast(quantiles(valid, "x", [0.25, 0.75]).select("q")))  # one row each
    iqr = F.col("q")[1] - F.col("q")[0]
    sturges = F.ceil(F.log2("n") + 1.0)
    fd = F.when(iqr > 0, F.ceil((F.col("high") - F.col("low")) / (2.0 * iqr / F.pow(F.col("n"), F.lit(1.0 / 3))))).otherwise(F.lit(1))
    s = s.select("low", "high", F.greatest(F.lit(1), sturges, fd).cast("int").alias("bins"))
    placed = valid.join(F.broadcast(s)).withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")))).otherwise(0).cast("int"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return placed.groupBy("bin", "low", "high", "bins").agg(F.count("*").alias("n")).select("bin", (F.col("low") + F.col("bin") * width).alias("from"), (F.col("low") + (F.col("bin") + 1) * width).alias("to"), "n")


def box_plot(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles by group, and the furthest values within 1.5 interquartile ranges of them."""
    valid = df.where(F.col(column).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("group"), d(F.col(column)).alias("x"))
    q = quantiles(valid, "x", [0.25, 0.5, 0.75], ["group"]).drop("n")
    fence = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("x") >= F.col("q")[0] - fence) & (F.col("x") <= F.col("q")[2] + fence)
    rows = valid.join(q, "group")
    return rows.groupBy("group", "q").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.sum((~inside).cast("long")).alias("outside")).select("group", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "outside")


def scatter_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope and intercept of the least-squares line, and r."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(d(F.col(x)).alias("x"), d(F.col(y)).alias("y"))
    return both.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    per = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def contextual(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """variable, contextual: whether it has at most one value in each cluster."""
    per = df.groupBy(cluster).agg(*[F.count_distinct(c).alias(c) for c in columns])
    flags = per.agg(*[(F.max(c) <= 1).alias(c) for c in columns])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("contextual")) for c in columns])).alias("v")).select("v.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r of each pair of columns over complete rows, from one aggregate."""
    rows = df.select(*[d(F.col(c)).alias(c) for c in columns]).na.drop()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("v")).select("v.*")


def cronbach(df: DataFrame, items: list[str]) -> DataFrame:
    """item (null for the whole scale), alpha: with all items, and with each left out."""
    rows = df.select(*[d(F.col(c)).alias(c) for c in items]).na.drop()
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    sums = [F.var_samp(c).alias(f"v_{c}") for c in items] + [F.var_samp(total).alias("v_all")] + [F.var_samp(total - F.col(c)).alias(f"w_{c}") for c in items]
    one = rows.agg(F.count("*").alias("n"), *sums)
    variances = sum((F.col(f"v_{c}") for c in items[1:]), F.col(f"v_{items[0]}"))
    k = float(len(items))
    alpha = lambda size, parts, whole: F.lit(size / (size - 1)) * (1.0 - parts / F.nullif(whole, F.lit(0.0))) if size > 1 else F.lit(None).cast("double")
    out = [F.struct(F.lit(None).cast("string").alias("item"), alpha(k, variances, F.col("v_all")).alias("alpha"))]
    out += [F.struct(F.lit(c).alias("item"), alpha(k - 1, variances - F.col(f"v_{c}"), F.col(f"w_{c}")).alias("alpha")) for c in items]
    return one.select("n", F.explode(F.array(*out)).alias("v")).select("v.item", "n", "v.alpha")
