import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from statloom.operators import bivariate, describe, factorial, multilevel, regression, reliability, survival
from statloom.sources.simulated import TRUE, survey


@pytest.fixture(scope="module")
def data(spark):
    df = survey(spark, 60, 25).cache()
    df.count()
    return df


def glr(df, y, xs, family):
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(df)
    m = GeneralizedLinearRegression(family=family, labelCol=y, maxIter=50, tol=1e-10).fit(rows)
    return np.append(m.intercept, m.coefficients.toArray()), np.array(m.summary.coefficientStandardErrors)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_likelihood_models_against_mllib(data, family):
    y = "outcome"
    fit = regression.logistic(data, y, ["x", "z"]) if family == "binomial" else regression._glm(data, y, ["x", "z"], "poisson", regression.poisson_step)[0]
    beta, se = glr(data, y, ["x", "z"], family)
    assert np.allclose(fit.coef, beta, atol=1e-5)
    assert np.allclose(fit.se, np.append(se[-1], se[:-1]), rtol=1e-4)


def test_ols_and_hc3(data):
    local = data.select("score", "x", "z").toPandas()
    x = np.column_stack([np.ones(len(local)), local.x, local.z])
    beta = np.linalg.lstsq(x, local.score, rcond=None)[0]
    e, inv = local.score.to_numpy() - x @ beta, np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    fit = regression.ols(data, "score", ["x", "z"])
    assert np.allclose(fit.coef, beta)
    assert np.allclose(fit.covariance, inv @ ((x * ((e / (1 - h)) ** 2)[:, None]).T @ x) @ inv)
    robust = regression.ols(data, "score", ["x", "z"], "cluster")
    assert robust.se[2] > fit.se[2]  # z varies between clusters only
    found = regression.linear_diagnostics(data, "score", ["x", "z"])
    assert 0 < found["cook_max"] < 1 and 0 <= found["bp_p"] <= 1


def test_firth_of_a_two_by_two_table(spark):
    rows = [(1.0, 1.0)] * 12 + [(1.0, 0.0)] * 3 + [(0.0, 1.0)] * 5 + [(0.0, 0.0)] * 20
    fit = regression.firth(spark.createDataFrame(rows, "x double, y double"), "y", ["x"])
    assert fit.coef[1] == pytest.approx(math.log(12.5 * 20.5 / (3.5 * 5.5)), abs=1e-6)


def test_separation_falls_back(spark):
    rows = [(float(i), float(i > 10)) for i in range(20)]
    fit = regression.logistic(spark.createDataFrame(rows, "x double, y double"), "y", ["x"])
    assert fit.kind == "firth" and np.all(np.isfinite(fit.coef))


def test_negative_binomial(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 3000)
    y = rng.poisson(np.exp(0.5 + 0.7 * x) * rng.gamma(1 / 0.8, 0.8, 3000))
    fit = regression.poisson(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "y", ["x"])
    assert fit.kind == "negative binomial" and fit.extra["dispersion"] == pytest.approx(0.8, abs=0.15) and fit.coef[1] == pytest.approx(0.7, abs=0.15)


def test_multinomial_against_mllib(data):
    fit = regression.multinomial(data, "group", ["x"], "a")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(data.withColumn("label", F.array_position(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("group")) - 1.0))
    m = LogisticRegression(family="multinomial", maxIter=200, tol=1e-12).fit(rows)
    c = np.column_stack([m.interceptVector.toArray(), m.coefficientMatrix.toArray()])
    assert np.allclose(fit.coef.reshape(2, 2), c[1:] - c[0], atol=1e-3)


def test_ordinal_and_brant(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal(3000), 1)
    u = rng.uniform(size=3000)
    y = np.digitize(0.9 * x + np.log(u / (1 - u)), [-1, 0.5, 2])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    fit = regression.ordinal(df, "y", ["x"])
    assert np.allclose(fit.coef, [-1, 0.5, 2, 0.9], atol=0.15)
    test = regression.brant(df, "y", ["x"])
    assert test["df"] == 2 and test["p"] > 0.01


def test_linear_mixed_model(data):
    m = multilevel.linear_mixed(data, "score", ["x"], "cluster")
    assert m.between == pytest.approx(1.44, abs=0.7) and m.residual == pytest.approx(2.6**2, rel=0.12) and m.fit.coef[1] == pytest.approx(1.5, abs=0.2)
    effects = multilevel.random_effects(data, "score", ["x"], "cluster", m)
    assert effects.count() == 60 and abs(effects.agg(F.avg("effect")).first()[0]) < 0.05


def test_logistic_mixed_model(data):
    m = multilevel.logistic_mixed(data, "outcome", ["x", "z"], "cluster")
    assert abs(m.fit.coef[1] - TRUE["x"]) < 0.2 and math.sqrt(m.between) == pytest.approx(TRUE["sigma"], abs=0.3) and m.p_variance < 0.01 and 0 < m.icc < 0.3


def test_cox_and_log_rank(data):
    found = {r["term"]: r for r in survival.cox(data, "time", "event", ["x"]).collect()}
    assert found["x"]["coef"] == pytest.approx(0.5, abs=0.1)
    c = survival.concordance(data, "time", "event", "x").first()["concordance"]
    assert 0.58 < c < 0.75
    p = survival.log_rank(survival.subjects(data, "time", "event", "group")).first()
    assert p["df"] == 2 and 0 <= p["p"] <= 1


def test_proportional_hazards_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 2))
    t, e = np.ceil(rng.exponential(8, 120)), (rng.random(120) < 0.7).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(u)) for a, b, (c, u) in zip(t, e, x, strict=True)], "t double, e double, x double, u double")
    found = {r["term"]: r for r in survival.cox(df, "t", "e", ["x", "u"]).collect()}
    beta = np.array([found[c]["coef"] for c in ("x", "u")])
    w, away, info, ranks = np.exp(x @ beta), [], np.zeros((2, 2)), []
    for time in np.unique(t[e == 1]):
        risk, dead = t >= time, (t == time) & (e == 1)
        m = dead.sum()
        means = []
        for k in range(m):
            v = w * risk - k / m * w * dead
            mean = v @ x / v.sum()
            means.append(mean)
            info += (x * v[:, None]).T @ x / v.sum() - np.outer(mean, mean)
        away += [row - np.mean(means, axis=0) for row in x[dead]]
        ranks += [np.sum(t < time) + 1.0] * m
    away, ranks = np.array(away), np.array(ranks)
    assert np.abs(away.sum(axis=0)).max() < 1e-5
    v = np.linalg.inv(info)
    assert [found[c]["se"] for c in ("x", "u")] == pytest.approx(np.sqrt(np.diag(v)), rel=1e-6)
    g, n = ranks - ranks.mean(), len(ranks)
    want = (g @ (n * away @ v)) ** 2 / (n * np.diag(v) * (g @ g))
    got = {r["term"]: r for r in survival.proportional_hazards(df, "t", "e", ["x", "u"]).collect()}
    assert [got[c]["chi2"] for c in ("x", "u")] == pytest.approx(want, rel=1e-4) and 0 <= got["x"]["p"] <= 1
    same = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.0, 2.0)], "t double, e double, x double")
    assert survival.proportional_hazards(same, "t", "e", ["x"]).first()["p"] is None


def test_random_slope_against_dense_likelihood(spark):
    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(60), 15)
    x = rng.normal(size=900)
    u = rng.multivariate_normal([0, 0], [[1.0, 0.3], [0.3, 0.5]], 60)
    y = 1 + 0.8 * x + u[group, 0] + u[group, 1] * x + rng.normal(size=900)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x, group, strict=True)], "y double, x double, g long")
    m = multilevel.random_slope(df, "y", ["x"], "g", "x")

    def dense(a, c, b, s2, beta):
        total = 0.0
        for j in range(60):
            z = np.column_stack([np.ones(15), x[group == j]])
            v = z @ np.array([[a, c], [c, b]]) @ z.T + s2 * np.eye(15)
            e = y[group == j] - z @ beta
            total -= 0.5 * (15 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))
        return total

    top = dense(m.between, m.covariance, m.slope, m.residual, m.fit.coef)
    assert m.fit.loglik == pytest.approx(top, abs=1e-4)
    for move in np.vstack([np.eye(4), -np.eye(4)]) * 0.03:
        assert dense(m.between + move[0], m.covariance + move[1], m.slope + move[2], m.residual + move[3], m.fit.coef) < top + 1e-4
    assert m.slope == pytest.approx(0.5, abs=0.3) and m.lr > 20 and m.p_slope < 1e-4
    stages = {r["stage"]: r for r in multilevel.staged(df, "y", ["x"], [], "g", False, "x").collect()}
    assert stages["M3"]["lr"] == pytest.approx(m.lr, abs=1e-3) and 0 < stages["M1"]["marginal"] < stages["M1"]["conditional"] < 1


def test_somers_against_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 5, 200)
    y = np.clip(x // 2 + rng.integers(0, 3, 200), 1, 3)
    df = spark.createDataFrame([(str(a), str(b)) for a, b in zip(x, y, strict=True)], "x string, y string")
    sign = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    s = sign.sum(axis=1)
    want = sign.sum() / np.sum(x[:, None] != x[None])
    z = sign.sum() / (2 * math.sqrt(np.sum(s**2) - sign.sum() ** 2 / 200))
    row = bivariate.compare_categories(df, "x", "y", ["1", "2", "3", "4"], ["1", "2", "3"]).first()
    assert row["test"] == "Somers" and row["effect"] == pytest.approx(want) and row["statistic"] == pytest.approx(z) and row["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_components(spark):
    rng = np.random.default_rng(7)
    f = rng.standard_normal(500)
    rows = [tuple(float(0.8 * v + 0.6 * e) for e in rng.standard_normal(5)) for v in f]
    xs = [f"v{i}" for i in range(5)]
    found = factorial.pca(spark.createDataFrame(rows, xs), xs)
    assert found["retained"] == 1 and found["kmo"] > 0.8 and found["interpretable"] and found["eigenvalues"].sum() == pytest.approx(5)
    noise = [tuple(map(float, r)) for r in rng.standard_normal((500, 5))]
    assert factorial.pca(spark.createDataFrame(noise, xs), xs)["retained"] == 0
    alpha = {r["item"]: r["alpha"] for r in describe.cronbach(spark.createDataFrame(rows, xs), xs).collect()}
    assert alpha[None] > 0.85


def test_typology_and_mca(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [8, 0], [0, 8]])
    rows = [(i, *map(float, centres[i % 3] + rng.standard_normal(2))) for i in range(150)]
    classes, k = factorial.classify(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], "id")
    found = {r["id"]: r["class"] for r in classes.collect()}
    assert k == 3 and all(len({found[i] for i in range(j, 150, 3)}) == 1 for j in range(3))
    cats = spark.createDataFrame([("x" if i % 2 else "y", "p" if i % 2 else "q", "m" if i % 3 else "n") for i in range(120)], "a string, b string, c string")
    m = factorial.mca(cats, ["a", "b", "c"])
    assert m["inertia"].sum() == pytest.approx(len(m["categories"]) / 3 - 1) and m["n"] == 120


def test_reliability(data):
    small = data.withColumn("x", F.round("x"))
    boot = reliability.bootstrap(small, "outcome", ["x", "z"], True, 40)
    assert 0.6 < boot["corrected"] <= boot["apparent"] + 0.01 and 0.7 < boot["slope"] < 1.2
    bent = data.withColumn("y", F.col("x") * F.col("x") + (F.pmod(F.xxhash64("x", "z", "score"), F.lit(1000)) / 1000.0 - 0.5))
    found = {r["term"]: r["p_holm"] for r in reliability.specification_search(bent, "y", ["x", "z"], "linear").collect()}
    assert found["spline(x)"] < 1e-6 and found["x x z"] > 0.001
    card = reliability.scorecard(data.sparkSession, {"vif_max": 1.2, "auc_corrected": 0.75, "left_out": 0.01, "calibration_slope": float("nan")}).collect()
    assert len(card) == 3 and card[0]["overall"] == "high"


def test_bootstrap_against_whole_arrays(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(float)
    rows = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y double, a double, b double")
    keyed = regression.design(rows.union(rows.limit(300)), "y", ["a", "b"]).groupBy("y", "x").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("y", "x")).toPandas()
    y, x, n, key = keyed["y"].to_numpy(), np.stack(keyed["x"]), keyed["n"].to_numpy(float), keyed["key"].to_numpy()
    drawn = reliability._draws(key, n, 12)

    def logit(x, w):
        b = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
        return b

    def auc(score, w):
        above = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
        pos, neg = w * y, w * (1 - y)
        return pos @ above @ neg / (pos.sum() * neg.sum())

    def r2(b, w):
        return 1 - (w @ (y - x @ b) ** 2) / (w @ (y - w @ y / w.sum()) ** 2)

    apparent = auc(x @ logit(x, n), n)
    fits = [logit(x, w) for w in drawn.T]
    optimism = np.mean([auc(x @ b, w) - auc(x @ b, n) for b, w in zip(fits, drawn.T, strict=True)])
    slope = np.mean([logit(np.column_stack([np.ones(len(x)), x @ b]), n)[1] for b in fits])
    got = reliability.bootstrap(rows.union(rows.limit(300)), "y", ["a", "b"], True, 12)
    assert got["auc_error"] < 1e-3 and abs(got["apparent"] - apparent) <= got["auc_error"]
    assert got["optimism"] == pytest.approx(optimism, abs=1e-4) and got["slope"] == pytest.approx(slope, abs=1e-6)
    line = lambda w: np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    got = reliability.bootstrap(rows.union(rows.limit(300)), "y", ["a", "b"], False, 12)
    assert got["apparent"] == pytest.approx(r2(line(n), n), abs=1e-9)
    assert got["optimism"] == pytest.approx(np.mean([r2(line(w), w) - r2(line(w), n) for w in drawn.T]), abs=1e-9)


def _logit(x, y, w):
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return b


def _rank_auc(score, y, w):
    of = np.unique(score, return_inverse=True)[1]
    pos, neg = np.bincount(of, w * y), np.bincount(of, w * (1 - y))
    return pos @ (np.cumsum(neg) - neg / 2) / (pos.sum() * neg.sum())


def test_bootstrap_of_a_large_table_takes_two_passes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.random((20_000, 2)) * 2 - 1
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    key = rows.select(F.xxhash64("y", F.array(F.lit(1.0), "a", "b"))).toPandas().iloc[:, 0].to_numpy()
    x, passes, sums = np.column_stack([np.ones(len(x)), x]), [], reliability._replicate_sums
    monkeypatch.setattr(reliability, "_replicate_sums", lambda *given: passes.append(given) or sums(*given))
    got = reliability.bootstrap(rows.crossJoin(spark.range(100)), "y", ["a", "b"], True, 12)
    assert len(passes) == 2  # one for all fits and slopes, one for AUC; each Newton step was a pass before
    n = np.full(len(x), 100.0)
    drawn = reliability._draws(key, n, 12)
    fits = [_logit(x, y, w) for w in drawn.T]
    assert got["slope"] == pytest.approx(np.mean([_logit(np.column_stack([x[:, 0], x @ b]), y, n)[1] for b in fits]), abs=1e-8)
    assert got["optimism"] == pytest.approx(np.mean([_rank_auc(x @ b, y, w) - _rank_auc(x @ b, y, n) for b, w in zip(fits, drawn.T, strict=True)]), abs=1e-5)
    assert abs(got["apparent"] - _rank_auc(x @ _logit(x, y, n), y, n)) <= got["auc_error"] < 1e-3

    few = slice(0, 2000)  # far from the fit of all rows: the bound is wide, and holds
    frame = spark.createDataFrame(pd.DataFrame({"y": y[few], "n": 1.0, "key": key[few], "x1": x[few, 1], "x2": x[few, 2]}))
    base, drawn = _logit(x[few], y[few], np.ones(2000)), reliability._draws(key[few], np.ones(2000), 12)
    assert reliability._whole_logit(frame, 3) == pytest.approx(base, abs=1e-8)
    tensors = [t[:-1] for t in reliability._expansions(frame, base, 12)]
    beta, left = reliability._near(tensors, base, x[few].min(0), x[few].max(0), np.tile(np.eye(3), (12, 1, 1)), np.tile(base, (12, 1)))
    away = np.abs(beta - [_logit(x[few], y[few], w) for w in drawn.T]).max(1)
    assert np.all(away <= 1.1 * left) and 1e-8 < left.min() and left.max() < 0.05


def test_bootstrap_of_skewed_scores_and_many_columns(spark):
    rng = np.random.default_rng(13)
    x = np.column_stack([np.exp(3 * rng.standard_normal(1200)), rng.standard_normal((1200, 7))])
    y = (rng.random(1200) < 1 / (1 + np.exp(-np.clip(x[:, 0] / 20, 0, 3) - x[:, 1] + 0.5 * x[:, 2]))).astype(float)
    names = [f"c{i}" for i in range(8)]
    rows = spark.createDataFrame(pd.DataFrame({"y": y} | {c: x[:, i] for i, c in enumerate(names)}))
    key = rows.select(F.xxhash64("y", F.array(F.lit(1.0), *names))).toPandas().iloc[:, 0].to_numpy()
    x, n = np.column_stack([np.ones(len(x)), x]), np.ones(len(x))
    drawn = reliability._draws(key, n, 10)
    fits = [_logit(x, y, w) for w in drawn.T]
    got = reliability.bootstrap(rows, "y", names, True, 10)
    assert abs(got["apparent"] - _rank_auc(x @ _logit(x, y, n), y, n)) <= got["auc_error"] < 1e-3
    assert got["optimism"] == pytest.approx(np.mean([_rank_auc(x @ b, y, w) - _rank_auc(x @ b, y, n) for b, w in zip(fits, drawn.T, strict=True)]), abs=2e-4)
    assert got["slope"] == pytest.approx(np.mean([_logit(np.column_stack([x[:, 0], x @ b]), y, n)[1] for b in fits]), abs=1e-6)


def test_draws_are_poisson_and_cheap():
    rng = np.random.default_rng(3)
    key = rng.integers(-(2**63), 2**63 - 1, 100_000)
    start = time.process_time()
    ones = reliability._draws(key, np.ones(len(key)), 50)
    assert time.process_time() - start < 1.0  # a generator for each row took some seconds
    for k in range(4):
        assert (ones == k).mean() == pytest.approx(np.exp(-1) / [1, 1, 2, 6][k], rel=5e-3)
    n = rng.choice([1.0, 7.0, 128.0, 129.0, 5000.0], 2000)
    drawn = reliability._draws(key[:2000], n, 50)
    assert np.array_equal(drawn[700:900], reliability._draws(key[700:900], n[700:900], 50))
    for c in np.unique(n):
        away = (drawn[n == c] - c) / np.sqrt(c)
        assert abs(away.mean()) < 0.04 and away.var() == pytest.approx(1.0, rel=0.05)
    assert abs(np.corrcoef(ones[:, :8].T) - np.eye(8)).max() < 0.02


def test_choice_of_tests(spark):
    rng = np.random.default_rng(9)
    two = spark.createDataFrame([("a" if i % 2 else "b", float(rng.standard_normal())) for i in range(120)], "g string, v double")
    skewed = spark.createDataFrame([("a" if i % 2 else "b", float(rng.exponential() ** 3)) for i in range(30)], "g string, v double")
    three = spark.createDataFrame([("abc"[i % 3], float(rng.standard_normal() * (1 + 4 * (i % 3)))) for i in range(150)], "g string, v double")
    names = [bivariate.compare_groups(df, "v", "g").first()["test"] for df in (two, skewed, three)]
    assert names == ["Welch t", "Mann-Whitney", "Welch ANOVA"]
    small = spark.createDataFrame([("a" if i < 6 else "b", "y" if i % 3 else "n") for i in range(12)], "x string, y string")
    assert bivariate.compare_categories(small, "x", "y").first()["test"] == "Fisher"


@pytest.mark.parametrize("take", ["concordance", "log_rank", "kaplan_meier"])
def test_survival_reads_rows_once(spark, take):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    kind = "t double, e int, s double, g string"
    rows = spark.createDataFrame([(float(i % 11), i % 2, float(i * 7 % 23), "ab"[i % 3 == 0]) for i in range(300)], kind).mapInPandas(watched, kind)
    if take == "concordance":
        assert survival.concordance(rows, "t", "e", "s").first()["pairs"] > 0
    else:
        getattr(survival, take)(survival.subjects(rows, "t", "e", "g")).collect()
    assert seen.value == 300


def test_halvings_are_counted_in_one_reading(spark, monkeypatch):
    monkeypatch.setattr(factorial, "MOST_LEAVES", 50)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rng = np.random.default_rng(5)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.random((2000, 2)))]
    rows = spark.createDataFrame(points, "id long, a double, b double").mapInPandas(watched, "id long, a double, b double")
    _, leaves = factorial.clustering_features(rows, ["a", "b"])
    assert seen.value == 2 * 2000  # spans, then all halvings
    got = leaves.toPandas()
    assert 10 < len(got) <= 50 and got["n"].sum() == 2000 and got["s0"].sum() == pytest.approx(sum(p[1] for p in points))
