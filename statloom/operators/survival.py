"""Survival: Kaplan-Meier curves, log-rank test, Cox model and its proportional hazards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import d
from statloom.functions.lineage import checkpointed
from statloom.operators.order import cuts_of, running_sums


def subjects(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """t, e (0 or 1) and group of rows with a time of at least zero and an event flag."""
    flag = F.when(d(F.col(event)) > 0, 1).otherwise(0)
    rows = df.where(F.col(time).isNotNull() & (F.col(time) >= 0) & F.col(event).isNotNull())
    if group:
        rows = rows.where(F.col(group).isNotNull())
    return rows.select(d(F.col(time)).alias("t"), flag.alias("e"), (F.col(group).cast("string") if group else F.lit("all")).alias("group"))


def times_of(rows: DataFrame) -> DataFrame:
    """group, t, d (events), m (leaving) of each distinct time. They are written down, so that rows are read, and
    whatever they are joined from, once, however often the times are read."""
    return checkpointed(rows.groupBy("group", "t").agg(F.sum("e").alias("d"), F.count("*").alias("m")))


def risk_table(rows: DataFrame) -> DataFrame:
    """group, t, d (events), m (leaving), at_risk of each distinct time; times are grouped before any window."""
    per = times_of(rows)
    totals = per.groupBy("group").agg(F.sum("m").alias("total"))
    run = running_sums(per, "t", {"m": "left"}, ["group"])
    return run.join(totals, "group").select("group", "t", "d", "m", (F.col("total") - F.col("left")).alias("at_risk"))


def kaplan_meier(rows: DataFrame) -> DataFrame:
    """group, t, d, at_risk, survival after t. A time at which all at risk have the event brings survival to zero."""
    table = risk_table(rows)
    steps = table.withColumn("l", F.when(F.col("d") < F.col("at_risk"), F.log(1.0 - d(F.col("d")) / d(F.col("at_risk")))).otherwise(F.lit(0.0))).withColumn("gone", (F.col("d") == F.col("at_risk")).cast("int"))
    run = running_sums(steps, "t", {"l": "earlier", "gone": "ended"}, ["group"])
    return run.select("group", "t", "d", "at_risk", F.when(F.col("ended") + F.col("gone") > 0, F.lit(0.0)).otherwise(F.exp(F.col("earlier") + F.col("l"))).alias("survival"))


def medians(curve: DataFrame) -> DataFrame:
    """group, median: the first time at which survival is at most one half (null if it never is)."""
    return curve.groupBy("group").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def log_rank(rows: DataFrame) -> DataFrame:
    """chi2, df, p of the k-sample log-rank test."""
    spark = rows.sparkSession
    per = times_of(rows).select("group", "t", d(F.col("d")).alias("d"), d(F.col("m")).alias("m"))
    groups = [r["group"] for r in per.select("group").distinct().orderBy("group").collect()]  # the groups compared
    k = len(groups)
    by_time = per.groupBy("t").agg(*[F.sum(F.when(F.col("group") == g, F.col("m")).otherwise(0.0)).alias(f"m{i}") for i, g in enumerate(groups)], *[F.sum(F.when(F.col("group") == g, F.col("d")).otherwise(0.0)).alias(f"d{i}") for i, g in enumerate(groups)])
    sizes = per.groupBy().agg(*[F.sum(F.when(F.col("group") == g, F.col("m"))).alias(f"n{i}") for i, g in enumerate(groups)])
    run = running_sums(by_time, "t", {f"m{i}": f"l{i}" for i in range(k)}).crossJoin(F.broadcast(sizes))  # one row
    r = [F.col(f"n{i}") - F.col(f"l{i}") for i in range(k)]
    total, deaths = sum(r[1:], r[0]), sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0"))
    share = F.when(total > 1, (total - deaths) / (total - 1.0)).otherwise(0.0)
    sums = [F.sum(F.col(f"d{i}")).alias(f"o{i}") for i in range(k)] + [F.sum(deaths * r[i] / total).alias(f"e{i}") for i in range(k)]
    sums += [F.sum(deaths * share * r[i] / total * ((1.0 if i == j else 0.0) - r[j] / total)).alias(f"v{i}_{j}") for i in range(k) for j in range(k)]
    s = run.where(deaths > 0).agg(*sums).first()
    z = np.array([s[f"o{i}"] - s[f"e{i}"] for i in range(k - 1)])
    v = np.array([[s[f"v{i}_{j}"] for j in range(k - 1)] for i in range(k - 1)])
    chi2 = float(z @ np.linalg.pinv(v) @ z)
    return spark.createDataFrame([(chi2, k - 1, dist.chi2_sf(chi2, k - 1))], "chi2 double, df int, p double")


class _Cox:
    """The sums of a Cox model with Efron's ties, taken by Spark for given coefficients.

    Weights, weighted covariates and their products are summed by distinct time, running sums turn them into sums over
    those still at risk, and one row a death holds its Efron term; only sums over all deaths reach the driver.
    """

    def __init__(self, df: DataFrame, time: str, event: str, xs: list[str]):
        rows = df.where(" and ".join(f"`{c}` is not null" for c in [time, event, *xs])).where(F.col(time) >= 0)
        self.p = len(xs)
        self.rows = rows.select(d(F.col(time)).alias("t"), F.when(d(F.col(event)) > 0, 1.0).otherwise(0.0).alias("e"), *[d(F.col(c)).alias(f"x{i}") for i, c in enumerate(xs)]).persist()
        centre = self.rows.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(self.p)]).first()
        self.x = [F.col(f"x{i}") - F.lit(float(centre[f"x{i}"] or 0.0)) for i in range(self.p)]
        self.pairs = [(i, j) for i in range(self.p) for j in range(i, self.p)]
        self.cuts = cuts_of(self.rows.select("t").distinct(), "t")

    def deaths(self, b: np.ndarray) -> DataFrame:
        """One row a death: its place k among those of its time t, rank (of t among all rows, the least of ties), z_i
        (the deaths' summed covariates), and Efron's s0, m_i and s2_i_j of those at risk."""
        x, p = self.x, self.p
        w = F.exp(sum((F.lit(float(b[i])) * x[i] for i in range(1, p)), F.lit(float(b[0])) * x[0]))
        parts = {"s0": w, **{f"s1_{i}": w * x[i] for i in range(p)}, **{f"s2_{i}_{j}": w * x[i] * x[j] for i, j in self.pairs}}
        died = {f"d{k}": F.col("e") * c for k, c in parts.items()}
        per = self.rows.groupBy("t").agg(F.count("*").cast("double").alias("m"), F.sum("e").alias("deaths"), *[F.sum(c).alias(k) for k, c in {**parts, **died}.items()], *[F.sum(F.col("e") * x[i]).alias(f"z_{i}") for i in range(p)])
        totals = per.agg(*[F.sum(k).alias(f"all_{k}") for k in parts])
        run = running_sums(per, "t", {"m": "before", **{k: f"b_{k}" for k in parts}}, cuts=self.cuts).crossJoin(F.broadcast(totals)).where("deaths > 0")  # one row
        each = run.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("deaths").cast("int") - 1)))
        at_risk = lambda k: F.col(f"all_{k}") - F.col(f"b_{k}") - F.col("k") / F.col("deaths") * F.col(f"d{k}")
        each = each.select("t", "k", "deaths", (F.col("before") + 1.0).alias("rank"), *[F.col(f"z_{i}") for i in range(p)], at_risk("s0").alias("s0"), *[at_risk(f"s1_{i}").alias(f"s1_{i}") for i in range(p)], *[at_risk(f"s2_{i}_{j}").alias(f"s2_{i}_{j}") for i, j in self.pairs])
        return each.select("t", "k", "rank", *[F.when(F.col("k") == 0, F.col(f"z_{i}")).otherwise(0.0).alias(f"z_{i}") for i in range(p)], "s0", *[(F.col(f"s1_{i}") / F.col("s0")).alias(f"m_{i}") for i in range(p)], *[(F.col(f"s2_{i}_{j}") / F.col("s0")).alias(f"s2_{i}_{j}") for i, j in self.pairs])

    def moments(self, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, score and information."""
        p = self.p
        sums = [F.sum(F.log("s0")).alias("log"), *[F.sum(f"z_{i}").alias(f"z_{i}") for i in range(p)], *[F.sum(f"m_{i}").alias(f"m_{i}") for i in range(p)], *[F.sum(F.col(f"s2_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"v_{i}_{j}") for i, j in self.pairs]]
        one = self.deaths(b).agg(*sums).first()
        z, m = (np.array([one[f"{k}_{i}"] or 0.0 for i in range(p)]) for k in "zm")
        info = np.zeros((p, p))
        for i, j in self.pairs:
            info[i, j] = info[j, i] = one[f"v_{i}_{j}"] or 0.0
        return float(b @ z) - (one["log"] or 0.0), z - m, info

    def fit(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and their covariance."""
        beta = np.zeros(self.p)
        ll, g, info = self.moments(beta)
        for _ in range(steps):
            move = np.linalg.pinv(info) @ g
            scale = 1.0
            for _ in range(20):
                new = self.moments(beta + scale * move)
                if np.isfinite(new[0]) and new[0] >= ll - 1e-10:
                    break
                scale /= 2
            beta, (ll, g, info) = beta + scale * move, new
            if np.max(np.abs(scale * move)) < 1e-8:
                break
        return beta, np.linalg.pinv(info)


def cox_tables(df: DataFrame, time: str, event: str, xs: list[str], steps: int = 30) -> tuple[DataFrame, DataFrame]:
    """cox() and proportional_hazards() of one fit."""
    model = _Cox(df, time, event, xs)
    beta, covariance = model.fit(steps)
    p = len(xs)
    away = [F.col(f"z_{i}") - F.col(f"m_{i}") for i in range(p)]
    one = model.deaths(beta).agg(F.count("*").cast("double").alias("n"), F.avg("rank").alias("mean"), F.var_pop("rank").alias("spread"), *[F.sum(away[i]).alias(f"r{i}") for i in range(p)], *[F.sum(F.col("rank") * away[i]).alias(f"g{i}") for i in range(p)]).first()
    model.rows.unpersist()
    se = np.sqrt(np.diag(covariance))
    terms = [(c, float(b), math.exp(b), float(s), float(b / s), 2 * dist.normal_sf(abs(b / s)), math.exp(b - 1.96 * s), math.exp(b + 1.96 * s)) for c, b, s in zip(xs, beta, se, strict=True)]
    with_time = np.array([(one[f"g{i}"] or 0.0) - (one["mean"] or 0.0) * (one[f"r{i}"] or 0.0) for i in range(p)])
    tests: list[tuple] = []
    for i, c in enumerate(xs):
        if not one["n"] or not one["spread"] or covariance[i, i] <= 0:
            tests.append((c, None, None))
            continue
        scaled = one["n"] * float(covariance[i] @ with_time)
        chi2 = scaled**2 / (one["n"] * covariance[i, i] * one["n"] * one["spread"])
        tests.append((c, float(chi2), float(dist.chi2_sf(float(chi2), 1))))
    table = df.sparkSession.createDataFrame
    return table(terms, "term string, coef double, hazard_ratio double, se double, z double, p double, low double, high double"), table(tests, "term string, chi2 double, p double")


def cox(df: DataFrame, time: str, event: str, xs: list[str], steps: int = 30) -> DataFrame:
    """Cox regression with Efron's ties: term, coef, hazard_ratio, se, z, p, low, high."""
    return cox_tables(df, time, event, xs, steps)[0]


def proportional_hazards(df: DataFrame, time: str, event: str, xs: list[str], steps: int = 30) -> DataFrame:
    """term, chi2, p: whether the scaled Schoenfeld residuals of a Cox model go with the rank of time.

    A time's residuals enter only through their sum, so the deaths' terms are summed with and without the rank. Both are
    null where no two deaths differ in rank.
    """
    return cox_tables(df, time, event, xs, steps)[1]


def concordance(df: DataFrame, time: str, event: str, score: str) -> DataFrame:
    """Harrell's C of a risk score and the pairs it rests on: those whose earlier time is an event; equal scores are half.

    Exact without pairs of rows: scores become dense ranks, and two ranks are told apart at the highest bit in which
    they differ. For each bit and the bits above it, counts by time meet through running sums. Counts by time and score
    are written down, so that rows are read once.
    """
    rows = df.where(f"`{time}` is not null and `{event}` is not null and `{score}` is not null").select(d(F.col(time)).alias("t"), F.when(d(F.col(event)) > 0, 1).otherwise(0).alias("e"), d(F.col(score)).alias("s"))
    counts = checkpointed(rows.groupBy("t", "s").agg(F.count("*").alias("n"), F.sum("e").alias("e")))
    ranks = running_sums(counts.select("s").distinct().withColumn("one", F.lit(1)), "s", {"one": "rank"})
    cells = counts.join(ranks.select("s", "rank"), "s").drop("s")
    bits = max(1, int(ranks.agg(F.max("rank").alias("r")).first()["r"] or 0).bit_length())
    high = F.expr(f"shiftright(rank, {bits} - level)")
    level = cells.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(bits)]))).withColumn("above", high)
    bit = F.expr(f"shiftright(rank, {bits - 1} - level) & 1")
    part = lambda b, c, name: F.sum(F.when(bit == b, F.col(c)).otherwise(0)).alias(name)
    per = level.groupBy("level", "above", "t").agg(part(0, "n", "n0"), part(1, "n", "n1"), part(0, "e", "e0"), part(1, "e", "e1"))
    totals = per.groupBy("level", "above").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    run = running_sums(per, "t", {"n0": "b0", "n1": "b1"}, ["level", "above"]).join(totals, ["level", "above"])
    later0, later1 = F.col("all0") - F.col("b0") - F.col("n0"), F.col("all1") - F.col("b1") - F.col("n1")
    told = run.agg(F.sum(d(F.col("e1")) * later0).alias("good"), F.sum(d(F.col("e0")) * later1).alias("bad"))
    by_time = cells.groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    every = running_sums(by_time, "t", {"n": "before"}).crossJoin(F.broadcast(by_time.agg(F.sum("n").alias("all"))))  # one row
    pairs = every.agg(F.sum(d(F.col("e")) * (F.col("all") - F.col("before") - F.col("n"))).alias("pairs"))
    both = told.crossJoin(pairs)  # one row each
    return both.select(((F.col("good") + F.col("pairs") - F.col("bad")) / 2.0 / F.nullif(F.col("pairs"), F.lit(0.0))).alias("concordance"), "pairs")
