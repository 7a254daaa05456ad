"""How far results can be trusted: bootstrap optimism, specification search, the scorecard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.expressions import d
from statloom.operators.order import adjust_p, quantiles
from statloom.operators.regression import _pairs_of, _symmetric, design, fit_kind

SEED, REPLICATES = 42, 200
#: Ranges of the score that AUC counts are kept in: quantiles of the whole table's score, each split in equal parts.
SCORE_QUANTILES, SCORE_PARTS = 128, 8
#: Cells of equal width that a score is looked up in, and replicates that are counted at once.
CELLS, COUNTED = 1 << 16, 20
MOST_STEPS, TOLERANCE, RIDGE = 30, 1e-8, 1e-6
#: Highest degree of the sums of products that stand for the rows near a fit (its bound holds up to 4), and most products.
MOST_DEGREE, MOST_PRODUCTS = 4, 250
#: Passes over the rows begin at a fit that is known this well.
START = 0.01
#: Rows that are weighed at once, and the largest mean whose counts are drawn by a table.
BLOCK, MOST_TABLED = 1024, 128


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each unsigned 64-bit number as one that looks random: the finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _poisson(mean: int) -> tuple[np.ndarray, np.ndarray]:
    """The distribution function at 0, 1, 2 ... of a Poisson count, and the count for each 16 leading bits of a uniform
    number; -1 where these bits leave it open."""
    k = np.arange(mean + 12 * math.isqrt(mean) + 24)
    below = np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1.0) for i in k])))
    at = np.searchsorted(below, np.arange((1 << 16) + 1) / (1 << 16), "right")
    return below, np.where(at[:-1] == at[1:], at[:-1], -1).astype(np.int16)


def _draws(key: np.ndarray, n: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson counts with mean n, one column a replicate, seeded by each row's key, so that a task run again draws alike.

    A 64-bit hash of the key and a number gives the leading bits of four replicates' uniform numbers, which are inverted
    by a table; where they leave the count open a further hash gives the rest. Large means take a generator a row.
    """
    seeds = _mixed(key.astype(np.int64).view(np.uint64) ^ np.uint64(SEED))
    step = np.uint64(0x9E3779B97F4A7C15)
    blocks = np.arange(1, -(-replicates // 4) + 1, dtype=np.uint64) * step
    bits = _mixed(seeds[:, None] + blocks).astype("<u8").view("<u2")[:, :replicates]
    out = np.empty(bits.shape)
    for c in np.unique(n).astype(np.int64).tolist():
        own = slice(None) if (n == c).all() else np.flatnonzero(n == c)
        if c > MOST_TABLED:
            out[own] = [np.random.default_rng([SEED, k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF]).poisson(c, replicates) for k in key[own].tolist()]
            continue
        below, counts = _poisson(c)
        told = np.take(counts, bits[own], mode="clip")
        i, r = np.divmod(np.flatnonzero(told < 0), replicates)
        rest = (_mixed(~seeds[own][i] + (r + 1).astype(np.uint64) * step) >> np.uint64(11)) / 2.0**53
        told[i, r] = np.searchsorted(below, (bits[own][i, r] + rest) / (1 << 16), "right")
        out[own] = told
    return out


def _replicate_sums(rows: DataFrame, shape: tuple[int, int], function, draws: int = 0, block: int = BLOCK) -> np.ndarray:
    """Sums over all rows of function(y, x, n, drawn), a matrix of this shape, added up in Spark. A column of drawn holds
    one of the draws' counts; without draws it is n."""
    replicates, size = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        np.empty(3 << 20)  # once a large array was freed, the allocator keeps what blocks free, and they fault no pages in anew
        for b in batches:
            y, n, key, *xs = (c.to_numpy() for c in b.columns)
            x = np.column_stack([np.ones(len(y)), *xs])
            for k in range(0, len(y), block):
                own = slice(k, k + block)
                total += function(y[own], x[own], n[own], _draws(key[own], n[own], draws) if draws else n[own][:, None])
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["r", "sums"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(v) for v in parts["sums"]), np.zeros(size))
        return pd.DataFrame({"r": parts["r"].iloc[:1], "sums": [total.tobytes()]})

    got = rows.mapInArrow(run, "r int, sums binary").groupBy("r").applyInPandas(add, "r int, sums binary").toPandas()
    out = np.zeros(shape)
    out[got["r"].to_numpy()] = [np.frombuffer(v) for v in got["sums"]]
    return out


def _chance(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -30, 30)))


def _replicate_logits(rows: DataFrame, start: np.ndarray, moments, draws: int = 0) -> np.ndarray:
    """Newton steps of all replicates' logistic fits at once, a row of start each; moments(beta) gives the function of
    each pass's sums, which are a gradient and then a matrix of curvature for each replicate."""
    beta, (replicates, k) = start, start.shape
    for _ in range(MOST_STEPS):
        sums = _replicate_sums(rows, (replicates, k + k * k), moments(beta), draws)
        curvature = sums[:, k:].reshape(replicates, k, k) + RIDGE * np.eye(k)
        step = np.linalg.solve(curvature, (sums[:, :k] - RIDGE * beta)[:, :, None])[:, :, 0]
        beta = beta + step
        if np.max(np.abs(step)) < TOLERANCE:
            break
    return beta


def _whole_logit(rows: DataFrame, k: int) -> np.ndarray:
    """Newton steps of the whole table's logistic fit, from sums of columns."""
    beta, x = np.zeros(k), [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k)]]
    for _ in range(MOST_STEPS):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))
        weighed = rows.withColumn("p", p).withColumns({"e": F.col("n") * (F.col("y") - F.col("p")), "v": F.col("n") * F.col("p") * (1.0 - F.col("p"))})
        one = weighed.agg(*[F.sum(F.col("e") * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(F.col("v") * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in _pairs_of(k)]).first()
        step = np.linalg.solve(_symmetric(one, "a", k) + RIDGE * np.eye(k), np.array([one[f"g{i}"] for i in range(k)]) - RIDGE * beta)
        beta = beta + step
        if np.max(np.abs(step)) < TOLERANCE:
            break
    return beta


def _products(k: int) -> list[np.ndarray]:
    """The products of k columns by degree, from 1, as the columns that each multiplies."""
    out = [np.arange(k)[:, None]]
    for degree in range(2, MOST_DEGREE + 1):
        if degree > 2 and sum(map(len, out)) + math.comb(k + degree - 1, degree) > MOST_PRODUCTS:
            break
        out.append(np.array(list(combinations_with_replacement(range(k), degree))))
    return out


def _expansions(rows: DataFrame, centre: np.ndarray, draws: int) -> list[np.ndarray]:
    """By degree, from 1, the symmetric tensors of each replicate, then of all rows: sums of w (y - p) x, then of the
    products of x times w and the derivatives of the chance p at the centre over their factorials. They give the gradient of
    the likelihood at any coefficients near the centre, without another pass."""
    k = len(centre)
    products = _products(k)
    before = [[{tuple(t): i for i, t in enumerate(low.tolist())}[tuple(t[:-1])] for t in high.tolist()] for low, high in zip(products, products[1:], strict=False)]

    def sums(y, x, n, drawn):
        p, columns = _chance(x @ centre), np.ascontiguousarray(x.T)
        v = p * (1 - p)
        parts, product_ = [columns * (y - p)], columns
        for high, low, slope in zip(products[1:], before, (v, v * (1 - 2 * p) / 2, v * (1 - 6 * v) / 6), strict=False):
            product_ = product_[low] * columns[high[:, -1]]
            parts.append(product_ * slope)
        part = np.vstack(parts)
        return np.vstack([(part @ drawn).T, part @ n])

    found = _replicate_sums(rows, (draws + 1, sum(map(len, products))), sums, draws)
    out, at = [], 0
    for own in products:
        place = {tuple(t): at + i for i, t in enumerate(own.tolist())}
        whole = [place[tuple(sorted(t))] for t in product(range(k), repeat=own.shape[1])]
        out.append(found[:, whole].reshape(-1, *[k] * own.shape[1]))
        at += len(own)
    return out


def _near(tensors: list[np.ndarray], centre: np.ndarray, low: np.ndarray, high: np.ndarray, span: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each replicate's fit q of coefficients span q, from the tensors at the centre, and a bound on the Newton step that a
    pass over the rows, which lie between low and high, would still take.

    Derivatives of the chance p up to the fourth are at most p (1 - p), which grows by at most e^t over a way t. So what the
    tensors leave out of a row's residual is at most p (1 - p) e^t t^degree / degree!, and by Cauchy and Schwarz it moves
    q_j by no more than that factor times the root of (curvature^-1)_jj and of the sum of w p (1 - p).
    """
    degree, q = len(tensors), start
    curvature = np.einsum("rim,rij,rjl->rml", span, tensors[1], span) + RIDGE * np.eye(span.shape[2])
    away = lambda q: np.einsum("rim,rm->ri", span, q) - centre
    with np.errstate(all="ignore"):
        for _ in range(MOST_STEPS):
            lost, d_ = 0.0, away(q)
            for t in tensors[:0:-1]:
                lost = np.einsum("r...i,ri->r...", t + lost, d_)
            gradient = np.einsum("rim,ri->rm", span, tensors[0] - lost) - RIDGE * q
            step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
            q = q + step
            if np.max(np.abs(step)) < TOLERANCE / 100:
                break
        d_ = away(q)
        reach = np.maximum(np.abs(np.maximum(d_ * low, d_ * high).sum(1)), np.abs(np.minimum(d_ * low, d_ * high).sum(1)))
        widest = np.sqrt(np.max(np.diagonal(np.linalg.inv(curvature), axis1=1, axis2=2), 1) * tensors[1][:, 0, 0])
        return q, np.max(np.abs(step), 1) + widest * np.exp(reach) * reach**degree / math.factorial(degree)


def _score_edges(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """Edges of the score's ranges: near-quantiles over all rows, with equal parts between neighbours."""
    eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta[1:], 1)), F.lit(float(beta[0])))
    shares = [k / SCORE_QUANTILES for k in range(SCORE_QUANTILES + 1)]
    q = np.unique(rows.agg(F.percentile_approx(eta, shares).alias("q")).first()["q"])
    parts = np.arange(SCORE_PARTS) / SCORE_PARTS
    return np.append((q[:-1, None] + parts * np.diff(q)[:, None]).ravel(), q[-1])


def _auc_counts(rows: DataFrame, beta: np.ndarray, edges: np.ndarray, draws: int) -> np.ndarray:
    """Counts by score (a row of beta), set (drawn, for the first scores, or all rows), outcome (1 or 0) and range of the
    score. Edges move to those of cells of equal width, in which a range is looked up, unless two would meet there."""
    scores, width = len(beta), len(edges) + 1
    scale = CELLS / (edges[-1] - edges[0]) if edges[-1] > edges[0] else math.nan
    cells = np.round((edges - edges[0]) * scale)
    tabled = bool(np.all(np.diff(cells) > 0)) and len(edges) > 1
    ranges = np.searchsorted(cells, np.arange(-1, CELLS + 1), "right") if tabled else None
    scaled = np.column_stack([(beta[:, 0] - edges[0]) * scale + 1, beta[:, 1:] * scale]) if tabled else beta

    def count(y, x, n, drawn):
        out = np.zeros((scores, 2, 2 * width))
        columns, outcome = np.ascontiguousarray(x.T), np.where(y > 0, 0, width)
        for r in range(0, scores, COUNTED):
            score = scaled[r : r + COUNTED] @ columns
            m, most = len(score), max(0, min(draws - r, COUNTED))
            if tabled:
                code = np.take(ranges, np.clip(score, 0, CELLS + 1, out=score).astype(np.intp), mode="clip")
            else:
                code = np.searchsorted(edges, score, "right")
            code += outcome
            code += np.arange(m)[:, None] * (2 * width)
            out[r : r + m, 1] = np.bincount(code.ravel(), np.broadcast_to(n, code.shape).ravel(), m * 2 * width).reshape(m, -1)
            if most:
                out[r : r + most, 0] = np.bincount(code[:most].ravel(), drawn[:, r : r + most].T.ravel(), most * 2 * width).reshape(most, -1)
        return out.reshape(scores, -1)

    return _replicate_sums(rows, (scores, 4 * width), count, draws, 10 * BLOCK).reshape(scores, 2, 2, width)


def _auc(counts: np.ndarray) -> np.ndarray:
    pos, neg = counts[..., 0, :], counts[..., 1, :]
    wins = np.sum(pos * (np.cumsum(neg, -1) - neg / 2), -1)
    return wins / np.maximum(pos.sum(-1) * neg.sum(-1), 1e-300)


def bootstrap(df: DataFrame, y: str, xs: list[str], binary: bool, replicates: int = REPLICATES) -> dict[str, float]:
    """Optimism-corrected AUC and calibration slope (binary) or R squared (linear).

    Rows stay distributed, as distinct patterns with counts. A replicate weighs each pattern by a Poisson count seeded
    by the pattern's hash, the limit of drawing rows with replacement. One pass sums what gives all replicates' gradients
    near the whole table's fit; passes that sum each replicate's own gradient and curvature follow where a bound on what is
    left out asks for them, as on small tables. Only these small matrices reach the driver. AUC counts pairs within one of
    some thousand ranges of the score as ties; auc_error bounds what that can change in the apparent AUC.
    """
    k = len(xs) + 1
    names = [f"x{i}" for i in range(1, k)]
    rows = design(df, y, xs).select("y", *[F.col("x")[i].alias(c) for i, c in enumerate(names, 1)]).groupBy("y", *names).agg(F.count("*").cast("double").alias("n"))
    rows = rows.select("y", "n", F.xxhash64("y", F.lit(1.0), *names).alias("key"), *names).persist()
    try:
        if not binary:
            return _linear_optimism(rows, k, replicates)

        def fitted(beta):
            def moments(y_, x, n, drawn):
                p = _chance(x @ beta.T)
                gradient = (drawn * (y_[:, None] - p)).T @ x
                products = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
                return np.hstack([gradient, (drawn * p * (1 - p)).T @ products])

            return moments

        base = _whole_logit(rows, k)
        ends = rows.agg(*[f(c) for f in (F.min, F.max) for c in ("n", *names)]).first()
        low, high = np.array([1.0, *ends[1:k]], float), np.array([1.0, *ends[k + 1 :]], float)
        tensors = _expansions(rows, base, replicates)
        drawn, whole = [t[:-1] for t in tensors], [np.repeat(t[-1:], replicates, 0) for t in tensors]
        beta, left = _near(drawn, base, low, high, np.tile(np.eye(k), (replicates, 1, 1)), np.tile(base, (replicates, 1)))
        if not np.max(left) < TOLERANCE:
            beta = _replicate_logits(rows, np.where((left < START)[:, None], beta, base), fitted, replicates)

        def calibrated(line):
            def moments(y_, x, n, drawn):
                eta = x @ beta.T
                p = _chance(line[:, 0] + line[:, 1] * eta)
                away, w = n[:, None] * (y_[:, None] - p), n[:, None] * p * (1 - p)
                cross = (w * eta).sum(0)
                return np.stack([away.sum(0), (away * eta).sum(0), w.sum(0), cross, cross, (w * eta * eta).sum(0)], 1)

            return moments

        itself = np.tile([0.0, 1.0], (replicates, 1))
        line, left = _near(whole, base, low, high, np.stack([np.tile(np.eye(k)[0], (replicates, 1)), beta], 2), itself)
        if not np.max(left) < TOLERANCE:
            line = _replicate_logits(rows, np.where((left < START)[:, None], line, itself), calibrated)
        counts = _auc_counts(rows, np.vstack([beta, base]), _score_edges(rows, base), replicates)
        auc, own = _auc(counts[:-1]), counts[-1, 1]
        apparent, optimism = float(_auc(own)), float(np.mean(auc[:, 0] - auc[:, 1]))
        error = float(np.sum(own[0] * own[1]) / 2 / max(own[0].sum() * own[1].sum(), 1e-300))
        return {"apparent": apparent, "optimism": optimism, "corrected": apparent - optimism, "slope": float(np.mean(line[:, 1])), "auc_error": error}
    finally:
        rows.unpersist()


def _linear_optimism(rows: DataFrame, k: int, replicates: int) -> dict[str, float]:
    """R squared from moments: one pass gives those of every replicate, another those of the table."""

    def moments(y, x, n, drawn):
        products = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
        return np.hstack([drawn.T @ products, drawn.T @ (x * y[:, None]), (drawn.T @ (y * y))[:, None]])

    sums = _replicate_sums(rows, (replicates, k * k + k + 1), moments, replicates)
    whole = _replicate_sums(rows, (1, k * k + k + 1), moments)[0]

    def r2(beta, m):
        a, b, yy = m[: k * k].reshape(k, k), m[k * k : -1], m[-1]
        return 1 - (yy - 2 * beta @ b + beta @ a @ beta) / max(yy - b[0] * b[0] / max(a[0, 0], 1e-300), 1e-300)

    solve = lambda m: np.linalg.pinv(m[: k * k].reshape(k, k)) @ m[k * k : -1]
    apparent = float(r2(solve(whole), whole))
    optimism = float(np.mean([r2(solve(m), m) - r2(solve(m), whole) for m in sums]))
    return {"apparent": apparent, "optimism": optimism, "corrected": apparent - optimism, "slope": math.nan}


def spline_knots(df: DataFrame, x: str) -> list[float]:
    return quantiles(df.select(d(F.col(x)).alias("x")), "x", [0.05, 0.35, 0.65, 0.95]).first()["q"]


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Restricted cubic spline: two columns beside x itself, linear beyond the outer knots."""
    cube = lambda k: F.pow(F.greatest(F.lit(0.0), d(x) - F.lit(float(k))), F.lit(3.0))
    a, b, c, e = knots
    scale = float((e - a) ** 2) or 1.0
    one = lambda k: (cube(k) - cube(c) * F.lit((e - k) / (e - c)) + cube(e) * F.lit((c - k) / (e - c))) / F.lit(scale)
    return [one(a), one(b)]


def specification_search(df: DataFrame, y: str, xs: list[str], kind: str, pairs: int = 6, importance: dict[str, float] | None = None) -> DataFrame:
    """term, lr, df, p, p_holm: gain from a spline of each number with ten values or more, and from interactions among
    the four most important columns (the first four where importance says nothing)."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    base = fit_kind(rows, y, xs, kind)
    distinct = rows.agg(*[F.count_distinct(c).alias(c) for c in xs]).first()
    out = []
    for x in xs:
        knots = spline_knots(rows, x) if distinct[x] >= 10 else []
        if len(set(knots)) == 4:
            wide = rows.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(spline_basis(F.col(x), knots))])
            lr = max(0.0, 2 * (fit_kind(wide, y, [*xs, "_s0", "_s1"], kind).loglik - base.loglik))
            out.append((f"spline({x})", float(lr), 2, float(dist.chi2_sf(lr, 2))))
    leading = sorted(xs, key=lambda c: -(importance or {}).get(c, 0.0))[:4]
    for a, b in [(a, b) for i, a in enumerate(leading) for b in leading[i + 1 :]][:pairs]:
        wide = rows.withColumn("_i", d(F.col(a)) * d(F.col(b)))
        lr = max(0.0, 2 * (fit_kind(wide, y, [*xs, "_i"], kind).loglik - base.loglik))
        out.append((f"{a} x {b}", float(lr), 1, float(dist.chi2_sf(lr, 1))))
    found = df.sparkSession.createDataFrame(out, "term string, lr double, df int, p double")
    return adjust_p(found, "p", "term").drop("p_bh")


#: Criteria: name, whether higher is better, limits of good and fair.
LIMITS = {
    "events_per_parameter": (True, 10.0, 5.0),
    "left_out": (False, 0.10, 0.20),
    "vif_max": (False, 5.0, 10.0),
    "auc_corrected": (True, 0.7, 0.6),
    "calibration_slope": (True, 0.9, 0.7),
    "boosting_gain": (False, 0.02, 0.05),
}


def scorecard(spark, values: dict[str, float]) -> DataFrame:
    """criterion, value, grade (good, fair, poor) and the overall grade over those that are known."""
    rows = []
    for name, value in values.items():
        up, good, fair = LIMITS[name]
        if value is None or value != value:
            continue
        rows.append((name, float(value), "good" if (value >= good if up else value <= good) else "fair" if (value >= fair if up else value <= fair) else "poor"))
    t = spark.createDataFrame(rows, "criterion string, value double, grade string")
    share = t.agg(F.avg((F.col("grade") == "good").cast("double")).alias("good"), F.avg((F.col("grade") == "poor").cast("double")).alias("poor"))
    overall = F.when(F.col("poor") > 1 / 3, "low").when((F.col("good") >= 2 / 3) & (F.col("poor") == 0), "high").otherwise("medium")
    return t.crossJoin(F.broadcast(share.select(overall.alias("overall"))))  # one row
