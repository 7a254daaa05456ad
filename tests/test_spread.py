"""Plans that spread busy keys and long orders give what plain ones give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from statloom.operators import audit, order, regression, results
from statloom.streaming import stateful


def _events(spark, n=400):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, r.choice(["busy", "busy", "calm", None]), start + dt.timedelta(seconds=r.choice([r.randrange(40_000), 1800 * r.randrange(40), 86_400 * 3 + r.randrange(9000)])) if r.random() > 0.05 else None) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, who string, at timestamp")


def test_window_counts_meet_slices(spark):
    rows, events = _events(spark)
    got = {r["id"]: r["in_window"] for r in stateful.window_counts(events, "who", "at", 600).collect()}
    same = lambda a, b: a[1] == b[1] and ((a[2] is None and b[2] is None) or (a[2] is not None and b[2] is not None and dt.timedelta(0) <= a[2] - b[2] <= dt.timedelta(seconds=600)))
    assert got == {a[0]: sum(same(a, b) for b in rows) for a in rows}


def test_window_counts_keep_columns(spark):
    _, events = _events(spark, 20)
    assert stateful.window_counts(events.withColumn("slice", F.lit(1)), "who", "at", 60).columns == ["id", "who", "at", "slice", "in_window"]


def test_sessions_join_runs_across_slices(spark):
    rows, events = _events(spark)
    # a run of events ten minutes apart that lasts over several slices
    run = [(1000 + k, "long", dt.datetime(2024, 1, 5) + dt.timedelta(minutes=10 * k)) for k in range(200)]
    got = stateful.sessions(events.union(spark.createDataFrame(run, events.schema)), "who", "at").collect()
    want = []
    for who in {x[1] for x in rows} | {"long"}:
        times = sorted(t for _, w, t in rows + run if w == who and t is not None)
        number = sum(w == who and t is None for _, w, t in rows)
        want += [(who, k + 1, None, None, 1) for k in range(number)]
        for t in times:
            if want and want[-1][0] == who and want[-1][3] is not None and t - want[-1][3] <= dt.timedelta(minutes=30):
                want[-1] = (*want[-1][:3], t, want[-1][4] + 1)
            else:
                number += 1
                want.append((who, number, t, t, 1))
    assert sorted(map(repr, ((r["who"], r["session"], r["start"], r["end"], r["n"]) for r in got))) == sorted(map(repr, want))


def test_newest_counts_later_days(spark):
    rows, events = _events(spark)
    got = {r["id"]: r["place"] for r in results.newest(events, "who", "at", "id").collect()}
    want = {}
    for who in {x[1] for x in rows}:
        mine = sorted((x for x in rows if x[1] == who), key=lambda x: (x[2] is None, -(x[2] - dt.datetime(2024, 1, 1)).total_seconds() if x[2] else 0, x[0]))
        want |= {x[0]: k + 1 for k, x in enumerate(mine)}
    assert got == want


def test_ranges_grow_with_the_rows(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).cast("double").alias("x"), F.lit(1).alias("one"))
    few, many = order.cuts_of(df, "x"), order.cuts_of(df, "x", 10)
    assert len(few) == 3 and 250 <= len(many) < 300
    told = df.select("x", order.cut_place(F.col("x"), many).alias("place")).collect()
    assert all(r["place"] == sum(c < r["x"] for c in many) for r in told)
    assert [r["below"] for r in order.running_sums(df, "x", {"one": "below"}, cuts=many).orderBy("x").collect()] == list(range(3000))
    assert order.cuts_of(df.where("x < 0"), "x") == []


@pytest.mark.parametrize("n", [3, 97, 500])
def test_hosmer_lemeshow_orders_ties_by_key(spark, n):
    r = random.Random(n)
    rows = [(k * 37 % n, float(r.random() < 0.4), r.choice([0.25, 0.25, 0.5, 0.75])) for k in range(n)]
    for kind in ("id", "cast(id as string)"):
        got = regression.hosmer_lemeshow(spark.createDataFrame(rows, "id long, y double, fitted double").selectExpr(f"{kind} AS id", "y", "fitted"), ["id"]).first()
        placed = sorted(rows, key=lambda x: (x[2], x[0] if kind == "id" else str(x[0])))
        chi2, at, used = 0.0, 0, 0
        for g in range(10):
            part = placed[at : at + n // 10 + (g < n % 10)]
            at += len(part)
            if part:
                o, e = sum(x[1] for x in part), sum(x[2] for x in part)
                chi2, used = chi2 + (o - e) ** 2 / (e * (1 - e / len(part))), used + 1
        assert got["chi2"] == pytest.approx(chi2) and got["df"] == used - 2


def test_missingness_tests(spark):
    r = random.Random(8)
    rows = [(k, None if k % 4 == 0 else 1.0, None if k % 50 == 0 else 1.0, None, 1.0, float(r.random() + (k % 4 == 0)), "yes" if r.random() < (0.7 if k % 4 == 0 else 0.3) else "no") for k in range(200)]
    df = spark.createDataFrame(rows, "id long, often double, seldom double, never double, always double, amount double, answer string")
    got = {x["variable"]: x for x in audit.missingness_tests(df, "amount", True, ["often", "seldom", "never", "always"]).collect()}
    assert list(got) == ["often"] and got["often"]["test"] == "Mann-Whitney" and got["often"]["p"] < 1e-10 and got["often"]["related"]
    a, b = [x[5] for x in rows if x[1] is None], [x[5] for x in rows if x[1] is not None]
    assert got["often"]["statistic"] == pytest.approx(sum((x > y) + (x == y) / 2 for x in a for y in b)) and got["often"]["rate"] == 0.25
    one = audit.missingness_tests(df, "answer", False, ["often", "never"]).collect()
    assert len(one) == 1
    o = [[sum((x[1] is None) == m and x[6] == y for x in rows) for y in ("no", "yes")] for m in (True, False)]
    e = [[sum(o[i]) * (o[0][j] + o[1][j]) / 200 for j in (0, 1)] for i in (0, 1)]
    chi2 = sum((abs(o[i][j] - e[i][j]) - min(0.5, abs(o[i][j] - e[i][j]))) ** 2 / e[i][j] for i in (0, 1) for j in (0, 1))
    assert one[0]["statistic"] == pytest.approx(chi2) and one[0]["p"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    assert audit.missingness_tests(df, "amount", True, ["always"]).count() == 0 and audit.missingness_tests(df.where("id < 0"), "amount", True).count() == 0
    few = audit.missingness_tests(df.where("id < 16"), "amount", True, ["often"])  # four rows without a value
    assert few.count() == 0
