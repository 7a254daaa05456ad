import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.operators import multilevel


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(1, 7), min_size=1, max_size=40))
def test_batches_end_with_their_clusters(names, sizes):
    rows = pd.DataFrame({"cluster": [str(x) for x in sorted(names)], "n": range(len(names))})
    cuts, at = [], 0
    for size in sizes:
        cuts.append(rows[at : at + size])
        at += size
    cuts.append(rows[at:])
    found = list(multilevel.whole_clusters(iter(cuts)))
    seen = [set(b["cluster"]) for b in found]
    assert all(seen) and sum(map(len, seen)) == len(set(names))  # no cluster in two batches
    assert [n for b in found for n in b["n"]] == list(range(len(names)))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    cluster = rng.integers(0, 30, 3000)
    cluster[:1000] = 7  # a third of all rows
    x, u = rng.integers(0, 3, 3000).astype(float), rng.normal(0, 1, 30)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(-0.3 + 0.4 * x + u[cluster])))).astype(float)
    return pd.DataFrame({"g": cluster.astype(str), "x": x, "y": y}), u


def test_modes_and_errors_of_logits(spark, rows):
    table, u = rows
    df = spark.createDataFrame(table)
    model = multilevel.logistic_mixed(df, "y", ["x"], "g")
    got = multilevel.random_effects(df, "y", ["x"], "g", model).toPandas().set_index("cluster")
    grid = np.linspace(-5, 5, 20_001)
    for name, part in table.groupby("g"):
        eta = (model.fit.coef[0] + model.fit.coef[1] * part["x"].to_numpy())[:, None]
        fine = grid[None, :]
        value = (part["y"].to_numpy()[:, None] * (eta + fine) - np.logaddexp(0, eta + fine)).sum(axis=0) - grid**2 / (2 * model.between)
        best = int(np.argmax(value))
        bend = -(value[best + 20] - 2 * value[best] + value[best - 20]) / (20 * (grid[1] - grid[0])) ** 2
        r = got.loc[name]
        assert r["effect"] == pytest.approx(grid[best], abs=6e-4) and r["se"] == pytest.approx(1 / math.sqrt(bend), rel=1e-3)
        assert r["n"] == len(part) and r["low"] == pytest.approx(r["effect"] - 1.96 * r["se"])
    assert np.corrcoef(got["effect"], u[got.index.astype(int)])[0, 1] > 0.9
    told = multilevel.extreme_clusters(multilevel.random_effects(df, "y", ["x"], "g", model)).first()
    assert (told["clusters"], told["above"], told["below"]) == (30, int((got["low"] > 0).sum()), int((got["high"] < 0).sum()))


def test_clusters_that_do_not_vary_and_nulls(spark):
    df = spark.createDataFrame([(str(k % 4), float(k // 4 % 2), 1.0 * (k // 8 % 2)) for k in range(160)] + [(None, 1.0, 1.0), ("1", None, 1.0)], "g string, y double, x double")
    model = multilevel.logistic_mixed(df, "y", ["x"], "g")
    got = multilevel.random_effects(df, "y", ["x"], "g", model).collect()
    assert sorted((r["cluster"], r["n"]) for r in got) == [(str(k), 40) for k in range(4)]
    assert all(abs(r["effect"]) < 0.01 for r in got) and model.between < 0.01
    assert multilevel.random_effects(df.limit(0), "y", ["x"], "g", model).count() == 0


@pytest.mark.parametrize("outcome", ["binary", "continuous"])
def test_the_configured_analysis_gives_effects(spark, rows, outcome):
    from statloom.plans.engine import AnalysisPlan, run

    table = rows[0].assign(w=lambda t: t["y"] + t["x"] / 7 + np.arange(len(t)) % 13)
    y = "y" if outcome == "binary" else "w"
    plan = AnalysisPlan(outcome=y, explanatory=("x",), cluster="g", analyses=("model", "multilevel"), kinds={y: outcome, "x": "continuous"})
    found = run(spark.createDataFrame(table), plan)
    effects = found["context_effects"].collect()
    assert len(effects) == 30 and sum(r["n"] for r in effects) == 3000 and found["context_extremes"].first()["clusters"] == 30
    assert {r["stage"] for r in found["multilevel"].collect()} == {"M0", "M1"}
