"""Two-level models: linear by clusters' sufficient statistics, with random slopes; logistic by adaptive quadrature."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import d
from statloom.operators.regression import Fit, design, logistic

NODES = 15


@dataclass(frozen=True)
class Mixed:
    """Fixed part, variance between clusters, residual variance (linear only), likelihood."""

    fit: Fit
    between: float
    residual: float
    clusters: int

    @property
    def icc(self) -> float:
        """Share of variance between clusters; on the latent scale where there is no residual variance."""
        rest = self.residual if self.residual == self.residual else math.pi**2 / 3
        return self.between / (self.between + rest)

    @property
    def median_odds_ratio(self) -> float:
        return math.exp(math.sqrt(2 * self.between) * dist.normal_ppf(0.75))

    @property
    def p_variance(self) -> float:
        """The variance lies on the edge of its range: half a chi-square with one degree of freedom."""
        lr = max(0.0, 2 * (self.fit.loglik - self.fit.loglik_null))
        return 0.5 * dist.chi2_sf(lr, 1) if lr > 0 else 1.0


def _statistics(rows: DataFrame, k: int) -> DataFrame:
    """Per cluster: n, sums of x, y, and of their products, by plain aggregates."""
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(k)]
    return rows.groupBy("cluster").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *[F.sum(x[i]).alias(f"s{i}") for i in range(k)], *sums)


def linear_mixed(df: DataFrame, y: str, xs: list[str], cluster: str) -> Mixed:
    """Random intercept, maximum likelihood. Clusters' sums are added up by cluster size, and the ratio of variances is
    searched on them: exact, with one pass over the rows."""
    k = len(xs) + 1
    per = _statistics(design(df, y, xs, cluster), k)
    # the likelihood needs each cluster only through its size and products of its sums, so equal sizes add up
    s = [F.col(f"s{i}") for i in range(k)]
    cross = [F.sum(s[i] * s[j]).alias(f"u{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(s[i] * F.col("sy")).alias(f"v{i}") for i in range(k)]
    plain = [F.sum(c).alias(c) for c in ["syy", *[f"a{i}_{j}" for i in range(k) for j in range(i, k)], *[f"b{i}" for i in range(k)]]]
    t = per.groupBy("n").agg(F.count("*").cast("double").alias("clusters"), F.sum(F.col("sy") * F.col("sy")).alias("w"), *cross, *plain).toPandas()
    n_j, count = t["n"].to_numpy(), t["clusters"].to_numpy()
    total = float(n_j @ count)

    def symmetric(prefix: str, weight: np.ndarray) -> np.ndarray:
        m = np.empty((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = float(weight @ t[f"{prefix}{i}_{j}"].to_numpy())
        return m

    ones = np.ones(len(t))

    def at(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        c = ratio / (1 + ratio * n_j)
        a = symmetric("a", ones) - symmetric("u", c)
        b = np.array([t[f"b{i}"].sum() - c @ t[f"v{i}"].to_numpy() for i in range(k)])
        yy = t["syy"].sum() - c @ t["w"].to_numpy()
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        s2 = (yy - beta @ b) / total
        ll = -total / 2 * (math.log(2 * math.pi * s2) + 1) - 0.5 * float(count @ np.log1p(ratio * n_j))
        return ll, beta, inverse * s2, s2

    low, high = math.log(1e-8), math.log(1e4)
    grid = np.linspace(low, high, 60)
    best = int(np.argmax([at(math.exp(g))[0] for g in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 59)]
    g = (math.sqrt(5) - 1) / 2
    while b - a > 1e-10:
        c, e = b - g * (b - a), a + g * (b - a)
        a, b = (a, e) if at(math.exp(c))[0] > at(math.exp(e))[0] else (c, b)
    ratio = math.exp((a + b) / 2)
    null = at(0.0)[0]
    if at(ratio)[0] < null:
        ratio = 0.0
    ll, beta, cov, s2 = at(ratio)
    return Mixed(Fit("linear mixed", ("(intercept)", *xs), beta, cov, int(total), ll, null), ratio * s2, s2, int(count.sum()))


def random_effects(df: DataFrame, y: str, xs: list[str], cluster: str, model: Mixed) -> DataFrame:
    """cluster, n, effect, se, low, high of a model's random intercepts.

    Of a linear model they are shrunken means of residuals; of a logit the modes of their posterior, with the standard
    error that its curvature there gives. Rows with a null in any column are left out; effects are 0 where the clusters
    don't vary.
    """
    if model.residual != model.residual:
        return _logistic_effects(df, y, xs, cluster, model)
    eta = F.lit(float(model.fit.coef[0]))
    for c, b in zip(xs, model.fit.coef[1:], strict=True):
        eta = eta + F.lit(float(b)) * d(F.col(c))
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs, cluster])).select(F.col(cluster).cast("string").alias("cluster"), (d(F.col(y)) - eta).alias("e"))
    per = rows.groupBy("cluster").agg(F.count("*").cast("double").alias("n"), F.avg("e").alias("m"))
    shrink = F.lit(model.between) * F.col("n") / (F.lit(model.between) * F.col("n") + F.lit(model.residual))
    effect, se = shrink * F.col("m"), F.sqrt(F.lit(model.between) * (1.0 - shrink))
    return _with_bounds(per.select("cluster", F.col("n").cast("long").alias("n"), effect.alias("effect"), se.alias("se")))


def _with_bounds(effects: DataFrame) -> DataFrame:
    return effects.select("*", (F.col("effect") - 1.96 * F.col("se")).alias("low"), (F.col("effect") + 1.96 * F.col("se")).alias("high"))


def extreme_clusters(effects: DataFrame) -> DataFrame:
    """clusters, and above and below: those whose interval lies on one side of 0."""
    return effects.agg(F.count("*").alias("clusters"), F.count_if(F.col("low") > 0).alias("above"), F.count_if(F.col("high") < 0).alias("below"))


def _patterns(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """Rows (cluster, x, yes, n), each cluster's together in one partition and one after another."""
    rows = design(df, y, xs, cluster)
    per = rows.groupBy("cluster", "x").agg(F.sum("y").alias("yes"), F.count("*").cast("double").alias("n"))
    return per.repartition("cluster").sortWithinPartitions("cluster")


def whole_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut anew at ends of clusters: no more than a batch and the cluster that goes on after it
    is held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        names = batch["cluster"].to_numpy()
        begins = int(np.argmax(names == names[-1]))  # of the cluster that may go on in the next batch
        if held and (begins or held[-1]["cluster"].iloc[-1] != names[-1]):
            # what is held goes on in the first rows at most, and ends before the batch's last cluster
            yield pd.concat([*held, batch[:begins]], ignore_index=True)
            held = []
        elif begins:
            yield batch[:begins].reset_index(drop=True)
        held.append(batch[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _modes(eta: np.ndarray, yes: np.ndarray, n: np.ndarray, group: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior modes of groups' standard normal effects, and the curvature of the log-posterior there."""
    m = group.max() + 1
    u = np.zeros(m)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(eta + sigma * u[group])))
        h = sigma**2 * np.bincount(group, n * p * (1 - p), m) + 1
        step = (sigma * np.bincount(group, yes - n * p, m) - u) / h
        u = u + np.clip(step, -2, 2)
        if np.max(np.abs(step)) < 1e-10:
            break
    p = 1 / (1 + np.exp(-(eta + sigma * u[group])))
    return u, sigma**2 * np.bincount(group, n * p * (1 - p), m) + 1


def _logistic_effects(df: DataFrame, y: str, xs: list[str], cluster: str, model: Mixed) -> DataFrame:
    beta, sigma = np.asarray(model.fit.coef, dtype=float), math.sqrt(model.between)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_clusters(batches):
            group, names = pd.factorize(b["cluster"])
            u, h = _modes(np.stack(b["x"].to_numpy()) @ beta, b["yes"].to_numpy(), b["n"].to_numpy(), group, sigma)
            yield pd.DataFrame({"cluster": names, "n": np.bincount(group, b["n"].to_numpy()).astype(np.int64), "effect": sigma * u, "se": sigma / np.sqrt(h)})

    return _with_bounds(_patterns(df, y, xs, cluster).mapInPandas(run, "cluster string, n long, effect double, se double"))


def climb(total: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, edge: Callable[[np.ndarray], bool], step: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The top of a log-likelihood that is taken at many points at once, by Newton steps with numeric derivatives, and
    the inverse of its curvature there. Ends early where theta reaches an edge."""
    size = len(theta)
    unit = np.eye(size) * step
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    moves = np.array([np.zeros(size), *[m for u in unit for m in (u, -u)], *[unit[i] + unit[j] for i, j in pairs]])
    for _ in range(25):
        f = total(theta + moves)
        up, down = f[1 : 2 * size + 1 : 2], f[2 : 2 * size + 2 : 2]
        hessian = np.diag((up - 2 * f[0] + down) / step**2)
        for q, (i, j) in enumerate(pairs):
            hessian[i, j] = hessian[j, i] = (f[2 * size + 1 + q] - up[i] - up[j] + f[0]) / step**2
        values, vectors = np.linalg.eigh(-hessian)
        safe = vectors @ np.diag(1 / np.maximum(values, 1e-3)) @ vectors.T
        move = np.clip(safe @ ((up - down) / (2 * step)), -1, 1)
        tries = np.array([0.5**s for s in range(6)])
        after = total(theta + tries[:, None] * move)
        best = int(np.argmax(after))
        if after[best] <= f[0] + 1e-9:
            break
        theta = theta + tries[best] * move
        if np.max(np.abs(tries[best] * move)) < 1e-5 or edge(theta):
            break
    return theta, safe


@dataclass(frozen=True)
class Slopes:
    """A linear model with random intercepts and random slopes of one covariate, against random intercepts alone."""

    fit: Fit
    between: float
    slope: float
    covariance: float
    residual: float
    clusters: int

    @property
    def lr(self) -> float:
        return max(0.0, 2 * (self.fit.loglik - self.fit.loglik_null))

    @property
    def p_slope(self) -> float:
        """The slope's variance lies on the edge of its range, its covariance doesn't: half a chi-square with one degree
        of freedom and half of one with two."""
        return 0.5 * dist.chi2_sf(self.lr, 1) + 0.5 * dist.chi2_sf(self.lr, 2) if self.lr > 0 else 1.0


def random_slope(df: DataFrame, y: str, xs: list[str], cluster: str, slope: str) -> Slopes:
    """Maximum likelihood with a random intercept and a random slope of `slope`, one of xs.

    Clusters' sums of products hold all that the likelihood needs; each step adds up their terms in Spark for many values
    of the variances at once, and fixed part and residual variance follow in closed form.
    """
    first = linear_mixed(df, y, xs, cluster)
    k, q = len(xs) + 1, xs.index(slope) + 1
    per = _statistics(design(df, y, xs, cluster), k).persist()
    upper = np.triu_indices(k)
    spread = df.agg(F.stddev_samp(d(F.col(slope))).alias("s")).first()["s"] or 1.0
    products, sums = [f"a{i}_{j}" for i, j in zip(*upper, strict=True)], [f"b{i}" for i in range(k)]
    width = 1 + k * k + k + 1

    def gathered(thetas: np.ndarray) -> np.ndarray:
        """For each theta: sums over clusters of log determinants, x'Vx, x'Vy and y'Vy, V relative to the residual."""

        def run(batches):
            out = np.zeros((len(thetas), width))
            for batch in batches:
                m = len(batch)
                a = np.zeros((m, k, k))
                a[:, upper[0], upper[1]] = batch[products].to_numpy()
                a[:, upper[1], upper[0]] = a[:, upper[0], upper[1]]
                b, yy = batch[sums].to_numpy(), batch["syy"].to_numpy()
                zx, zy = a[:, [0, q], :], b[:, [0, q]]
                zz = zx[:, :, [0, q]]
                for at, (u, v, w) in enumerate(thetas):
                    root = np.array([[math.exp(u), 0.0], [v / spread, math.exp(w) / spread]])  # in deviations of the covariate
                    inner = np.eye(2) + root.T @ zz @ root
                    weight = root @ np.linalg.inv(inner) @ root.T
                    wx, wy = weight @ zx, np.einsum("mij,mj->mi", weight, zy)
                    out[at, 0] += np.sum(np.log(np.linalg.det(inner)))
                    out[at, 1 : 1 + k * k] += (a.sum(axis=0) - np.einsum("mai,maj->ij", zx, wx)).ravel()
                    out[at, 1 + k * k : -1] += b.sum(axis=0) - np.einsum("mai,ma->i", zx, wy)
                    out[at, -1] += yy.sum() - np.sum(zy * wy)
            yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

        got = per.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        return got.reshape(len(thetas), width)

    n = first.fit.n

    def solved(row: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        a, b = row[1 : 1 + k * k].reshape(k, k), row[1 + k * k : -1]
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        s2 = float(row[-1] - beta @ b) / n
        return -n / 2 * (math.log(2 * math.pi * s2) + 1) - 0.5 * row[0], beta, inverse * s2, s2

    ratio = math.sqrt(max(first.between / first.residual, 1e-4))
    theta, _ = climb(lambda t: np.array([solved(r)[0] for r in gathered(t)]), np.array([math.log(ratio), 0.0, math.log(0.5 * ratio)]), lambda t: min(t[0], t[2]) < -9)
    ll, beta, covariance, s2 = solved(gathered(theta[None, :])[0])
    per.unpersist()
    if ll <= first.fit.loglik:  # slopes that don't vary
        return Slopes(Fit("random slope", first.fit.names, first.fit.coef, first.fit.covariance, n, first.fit.loglik, first.fit.loglik), first.between, 0.0, 0.0, first.residual, first.clusters)
    u, v, w = math.exp(theta[0]), float(theta[1]) / spread, math.exp(theta[2]) / spread
    return Slopes(Fit("random slope", first.fit.names, beta, covariance, n, ll, first.fit.loglik), s2 * u * u, s2 * (v * v + w * w), s2 * u * v, s2, first.clusters)


def explained(df: DataFrame, xs: list[str], cluster: str, model: Mixed) -> tuple[float, float]:
    """Marginal and conditional R squared: the fixed part's share of variance, and that of it and the clusters."""
    if not xs:
        return 0.0, model.icc
    eta = sum((F.lit(float(b)) * d(F.col(c)) for c, b in zip(xs[1:], model.fit.coef[2:], strict=True)), F.lit(float(model.fit.coef[1])) * d(F.col(xs[0])))
    fixed = df.agg(F.var_pop(eta).alias("v")).first()["v"] or 0.0
    rest = model.residual if model.residual == model.residual else math.pi**2 / 3
    return fixed / (fixed + model.between + rest), (fixed + model.between) / (fixed + model.between + rest)


def logistic_mixed(df: DataFrame, y: str, xs: list[str], cluster: str, nodes: int = NODES) -> Mixed:
    """Random-intercept logit. Clusters are independent, so each likelihood is a sum over tasks, which hold whole clusters
    as (pattern, count) rows, a batch of them at a time; the search for its top runs on the driver with numeric
    derivatives."""
    k = len(xs) + 1
    held = _patterns(df, y, xs, cluster).persist()
    points, weights = np.polynomial.hermite.hermgauss(nodes)

    def total(thetas: np.ndarray) -> np.ndarray:
        """Log-likelihoods at each row of thetas (coefficients, log sigma)."""

        def run(batches):
            out = np.zeros(len(thetas))
            for b in whole_clusters(batches):
                x, yes, n = np.stack(b["x"].to_numpy()), b["yes"].to_numpy(), b["n"].to_numpy()
                group = pd.factorize(b["cluster"])[0]
                for at, theta in enumerate(thetas):
                    eta, sigma = x @ theta[:k], math.exp(theta[k])
                    u, h = _modes(eta, yes, n, group, sigma)
                    s = 1 / np.sqrt(h)
                    parts = []
                    for z, w in zip(points, weights, strict=True):
                        v = u + math.sqrt(2) * s * z
                        e = eta + sigma * v[group]
                        parts.append(math.log(w) + z * z + np.bincount(group, yes * e - n * np.logaddexp(0, e), len(u)) - v * v / 2)
                    out[at] += np.sum(np.logaddexp.reduce(parts, axis=0) + np.log(s) + 0.5 * math.log(2) - 0.5 * math.log(2 * math.pi))
            yield pd.DataFrame({"i": np.arange(len(out)), "v": out})

        return held.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()

    start = logistic(df, y, xs)
    theta, safe = climb(total, np.append(start.coef, math.log(0.7)), lambda theta: theta[k] < -6)
    ll = float(total(theta[None, :])[0])
    clusters = held.select("cluster").distinct().count()
    held.unpersist()
    between = math.exp(2 * theta[k])
    fit = Fit("logistic mixed", ("(intercept)", *xs), theta[:k], safe[:k, :k], start.n, max(ll, start.loglik), start.loglik)
    return Mixed(fit, between if ll >= start.loglik else 0.0, math.nan, clusters)


#: Clusters below which, and mean cluster size below which, staged() warns.
FEW_CLUSTERS, SMALL_CLUSTERS = 10, 5


def staged(df: DataFrame, y: str, level1: list[str], level2: list[str], cluster: str, binary: bool, slope: str | None = None) -> DataFrame:
    """stage, between, residual, icc, loglik, share of the empty model's variance explained, clusters, marginal and
    conditional R squared, slope variance, lr and p of the slope, warning; for M0, M1, M2 and, with a slope in a linear
    model, M3.

    At least three clusters are needed; grand-mean centring is up to the caller.
    """
    fit = logistic_mixed if binary else linear_mixed
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *level1, *level2, cluster]))
    out, first = [], None
    warning = None
    for name, xs in (("M0", []), ("M1", level1), ("M2", [*level1, *level2])):
        if name == "M2" and not level2:
            continue
        m = fit(rows, y, xs, cluster)
        if m.clusters < 3:
            raise ValueError("a multilevel model needs three clusters at least")
        warning = "few clusters" if m.clusters < FEW_CLUSTERS else "small clusters" if m.fit.n / m.clusters < SMALL_CLUSTERS else None
        first = first or m
        marginal, conditional = explained(rows, xs, cluster, m)
        out.append((name, float(m.between), float(m.residual), float(m.icc), float(m.fit.loglik), float(1 - m.between / first.between) if first.between > 0 else math.nan, m.clusters, float(marginal), float(conditional), None, None, None, warning))
    every = [*level1, *level2]
    if slope in every and not binary:
        m = random_slope(rows, y, every, cluster, slope)
        out.append(("M3", float(m.between), float(m.residual), None, float(m.fit.loglik), None, m.clusters, None, None, float(m.slope), float(m.lr), float(m.p_slope), warning))
    return df.sparkSession.createDataFrame(out, "stage string, between double, residual double, icc double, loglik double, explained double, clusters int, marginal double, conditional double, slope double, lr double, p double, warning string")


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their overall means."""
    means = df.agg(*[F.avg(d(F.col(c))).alias(f"_m_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(means))  # one row
    return joined.select(*[(d(F.col(c)) - F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
