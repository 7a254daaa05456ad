import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import boosting
from statloom.operators.boosting import Settings
from statloom.operators.regression import fit_kind, logistic
from statloom.plans.engine import AnalysisPlan, run


def brute(y, bins, fold, settings, binary):
    """Scores of every row under every fold's model, grown leaf by leaf from whole arrays."""
    raw = np.empty((len(y), settings.folds))
    for m in range(settings.folds):
        own = np.flatnonzero(fold != m)
        mean = y[own].mean()
        raw[:, m] = np.log(mean / (1 - mean)) if binary else mean
        for _ in range(settings.rounds):
            p = 1 / (1 + np.exp(-raw[:, m]))
            g, h = (p - y, p * (1 - p)) if binary else (raw[:, m] - y, np.ones(len(y)))

            def best(rows):
                out = (1e-9, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + settings.ridge)
                for f in range(bins.shape[1]):
                    for cut in range(255):
                        low = bins[rows, f] <= cut
                        a, b = rows[low], rows[~low]
                        if len(a) < settings.least_rows or len(b) < settings.least_rows:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + settings.ridge) + g[b].sum() ** 2 / (h[b].sum() + settings.ridge) - whole
                        if gain > out[0] + 1e-9:
                            out = (gain, (f, cut))
                return out

            leaves = [(own, np.arange(len(y)), *best(own))]  # training rows, all rows, gain, split
            while len(leaves) < settings.leaves and any(x[3] for x in leaves):
                k = max(range(len(leaves)), key=lambda i: leaves[i][2] if leaves[i][3] else -1)
                rows, every, _, (f, cut) = leaves.pop(k)
                leaves += [(rows[side(bins[rows, f] <= cut)], every[side(bins[every, f] <= cut)], *best(rows[side(bins[rows, f] <= cut)])) for side in (np.asarray, np.logical_not)]
            if len(leaves) > 1:
                for rows, every, *_ in leaves:
                    raw[every, m] -= settings.rate * g[rows].sum() / (h[rows].sum() + settings.ridge)
    return raw


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 500
    a, b, c = rng.integers(0, 12, n), np.round(rng.normal(size=n), 1), rng.integers(0, 3, n)
    eta = 1.5 * (a > 6) * (b > 0) - 0.7 + 0.3 * b
    rows = [(float(rng.random() < 1 / (1 + np.exp(-e))), float(e + rng.normal() / 3), int(x), float(y), int(z), int(k % 40)) for k, (e, x, y, z) in enumerate(zip(eta, a, b, c))]
    return spark.createDataFrame(rows, "y double, s double, a long, b double, c long, house long").repartition(3).persist()


@pytest.mark.parametrize("binary", [True, False])
def test_trees_against_whole_arrays(table, binary, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    settings = Settings(rounds=5, leaves=6, rate=0.2, folds=3, least_rows=15)
    rows = boosting.folded(table, "y" if binary else "s", ["a", "b", "c"], "house", 3).persist()
    model, state = boosting.boost(rows, ["a", "b", "c"], binary, settings)
    local = state.toPandas()
    bins = np.frombuffer(b"".join(local["bins"]), np.uint8).reshape(len(local), 3)
    want = brute(local["y"].to_numpy(), bins, local["fold"].to_numpy(), settings, binary)
    assert np.allclose(np.stack(local["raw"].to_numpy()), want, atol=1e-9)
    assert all(len(t.feature) <= 11 for trees in model.trees for t in trees)


def test_clusters_stay_whole(table):
    keyed = table.withColumn("y", F.col("house").cast("double"))
    assert boosting.folded(keyed, "y", ["a"], "house", 5).groupBy("y").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty()


def test_permutation(spark):
    rows = spark.range(1000).select(boosting.permuted(F.col("id"), F.lit(1000), F.lit(7)).alias("to")).toPandas()["to"]
    assert sorted(rows) == list(range(1000)) and abs(np.corrcoef(rows, np.arange(1000))[0, 1]) < 0.1


def test_importance(table):
    measures, importance = boosting.cross_validated(table, "y", ["a", "b", "c"], True, "house", {"a": ["a"], "rest": ["b", "c"], "c": ["c"]}, Settings(rounds=12, rate=0.2, folds=3))
    found = {r["variable"]: r["importance"] for r in importance.collect()}
    assert set(found) == {"a", "rest", "c"} and found["a"] > 0.02 and found["rest"] > 0.02 and abs(found["c"]) < 0.03
    by = measures.groupBy("model").agg(F.avg("measure").alias("m"), F.count("*").alias("n")).collect()
    assert {r["model"]: r["n"] for r in by} == {"usual": 3, "boosted": 3} and all(0.6 < r["m"] < 0.95 for r in by)


def test_quality(table, spark):
    rows = [(0, "v", 1.0, 0.9), (0, "v", 0.0, 0.9), (0, "v", 0.0, 0.1), (0, None, 1.0, 0.2), (0, None, 0.0, 0.4)]
    got = {r["variable"]: r["measure"] for r in boosting.quality(spark.createDataFrame(rows, "fold int, variable string, y double, score double"), ["fold", "variable"], True).collect()}
    assert got == {"v": 0.75, "": 0.0}


def test_engine(table):
    plan = AnalysisPlan(outcome="y", explanatory=("a", "b", "c"), cluster="house", level2=("c",), analyses=("model", "reliability"), kinds={"y": "binary", "a": "continuous", "b": "continuous", "c": "nominal"}, boosting_rounds=3)
    found = run(table, plan)
    assert {r["variable"] for r in found["importance"].collect()} == {"a", "b", "c"}
    assert {r["criterion"] for r in found["reliability"].collect()} >= {"boosting_gain", "auc_corrected", "vif_max"}
    assert found["specification"].where("term LIKE '% x %'").count() == 6 and found["nested"].agg(F.max("model")).first()[0] == 2
    rows = table.where("y is not null").withColumns({"c1": (F.col("c") == 1).cast("double")})
    assert not np.allclose(fit_kind(rows, "y", ["a", "b"], "logistic", "house").se, fit_kind(rows, "y", ["a", "b"], "logistic").se)


@pytest.mark.parametrize("value", [0.0])
def test_outcome_with_one_class(table, value):
    fit = logistic(table.withColumn("y", F.lit(value)), "y", ["a", "b"])
    assert fit.kind == "firth" and np.all(np.isfinite(fit.coef)) and (fit.coef[0] > 0) == (value == 1.0)


def test_importance_needs_no_usual_model(spark, monkeypatch):
    from statloom.operators import regression

    def never(*_):
        raise AssertionError("a usual model was fitted")

    table = spark.range(0, 1000, 1, 2).selectExpr("id", "cast(id % 7 as double) AS a", "cast(pmod(xxhash64(id), 5) as double) AS b", "cast(id % 7 > 3 as double) AS y")
    settings = Settings(rounds=1, rate=0.9, folds=2, leaves=3)
    want = boosting.cross_validated(table, "y", ["a", "b"], True, "id", None, settings)[1].orderBy("variable").collect()
    monkeypatch.setattr(regression, "fit_kind", never)
    got = boosting.importance(table, "y", ["a", "b"], True, "id", None, settings).orderBy("variable").collect()
    assert got == want and got[0]["importance"] > 0.3 > 0.05 > abs(got[1]["importance"])
