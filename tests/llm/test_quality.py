from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import positive_unlabelled, quality


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab #|é\n\t\u2003", max_size=80)))
def test_statistics(text):
    assert quality.statistics(None if text is None else text.encode())[0] == brute(text)


def test_many_distinct_words_take_the_other_path():
    ids = np.array([0, 1, 2, 9, 0, 1, 2])
    assert quality._repeated(ids, 10) == quality._repeated(ids, 1 << 22) == 6


def good(k):
    return " ".join(f"word{(7 * i + k) % 97} and{(5 * i + 3 * k) % 89}" for i in range(60)) + "."


def bad(k):
    return " ".join(f"w{i + k}### $$$ |" for i in range(40))


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(k, good(k) if k % 4 else bad(k), "x") for k in range(200)]
    docs += [(900, None, "x"), (901, "", "x"), (902, good(902), "x"), (902, good(902), "x"), (None, good(3), "x"), (903, "long " + good(5) * 200, "x")]
    labels = [(k, int(k % 4 > 0), 0) for k in range(200)] + [(902, 1, 0), (902, 0, 0), (77, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_forest_tells_junk(tables):
    rows = quality.quality_rules(*tables).collect()
    assert len(rows) == 206
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[k][0]["kept"] == bool(k % 4) for k in range(200))
    assert by[900][0]["base_failed"] and by[901][0]["n_words"] == 0 and not by[900][0]["kept"]
    assert len(by[902]) == 2 and by[902][0]["anomaly"] == by[902][1]["anomaly"]


def test_keep_agrees_with_the_verdicts(tables):
    docs, labels = tables
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality.quality_rules(docs, labels).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_without_labels_or_rows(tables, spark):
    docs, labels = tables
    none = labels.limit(0)
    assert quality.quality_rules(docs, none).where("kept = base_failed").count() == 0
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert positive_unlabelled.classify(docs.limit(0), labels).count() == 0


def test_calibration_ties():
    scores, ok = np.array([0.1, 0.2, 0.2, 0.9]), np.array([True, True, False, False])
    assert 0.2 < quality.calibrate(scores, ok) < 0.9
    assert quality.calibrate(scores, np.ones(4, dtype=bool)) == float("inf")


def test_positive_unlabelled(tables):
    docs, labels = tables
    rows = positive_unlabelled.classify(docs, labels).collect()
    assert len(rows) == 206 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    import zlib

    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.9
    none = positive_unlabelled.classify(docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {positive_unlabelled.DEFAULT_PRIOR}


def test_held_out_accuracy(spark, sf_dir):
    import pandas as pd

    from statloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_classifier"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    auc = np.mean(held.score[held.quality == 1].to_numpy()[:, None] > held.score[held.quality == 0].to_numpy()[None, :])
    assert auc > 0.99 and (held.predicted == held.quality).mean() > 0.93


def test_limit_covers_all_labelled_rows(spark):
    texts = {k: good(k) + " ###" * (k % 20) for k in range(200)}
    known = {k: (k * 37) // 20 % 20 >= k % 20 for k in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(ok)) for k, ok in known.items()], "doc_id long, quality int")
    forest, limit = quality.fit(docs, labels, most=8)
    score = {k: forest.anomaly(np.array([quality.statistics(v.encode())[1]]))[0] for k, v in texts.items()}
    gain = lambda at: 4 * np.mean([score[k] <= at for k, ok in known.items() if ok]) - np.mean([score[k] <= at for k, ok in known.items() if not ok])
    found = (gain(limit), max(gain(v) for v in score.values()))
    assert found[0] >= found[1] - 0.01, found


def test_positive_unlabelled_against_brute_force(spark, sf_dir):
    """The query's scores are those of weights found by plain gradient steps over all open rows in one process, up to a
    bias that makes the share of higher scores the prior."""
    import zlib

    import pandas as pd

    from statloom.llm.queries import QUERIES

    pu = positive_unlabelled
    docs, labels = pd.read_parquet(f"{sf_dir}/documents.parquet"), pd.read_parquet(f"{sf_dir}/labels.parquet")
    is_open = lambda ids: np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in ids])
    x = np.stack([pu.features(None if t is None else t.encode()) for t in docs.text]).astype(float)
    u = x[is_open(docs.doc_id)]
    good = set(labels[is_open(labels.doc_id) & (labels.quality == 1)].doc_id)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    put = lambda rows: np.hstack([np.clip((rows - mean) / scale, -8, 8), np.ones((len(rows), 1))])
    order = docs.doc_id.sort_values().index
    p, u = put(x[[i for i in order if docs.doc_id[i] in good]]), put(u)
    mixed = np.random.default_rng(pu.SEED).permutation(len(p))
    halves = p[mixed[: len(p) // 2]], p[mixed[len(p) // 2 :]]
    ridge = np.append(np.full(x.shape[1], pu.RIDGE), 1e-6)
    sig = lambda z: 1 / (1 + np.exp(-z))

    def descend(slope):
        w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
        for t in range(1, 12_001):
            g = slope(w) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.02 / (1 + t / 1500) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        return w

    priors = []
    for seen, aside in (halves, halves[::-1]):
        teller = descend(lambda w, seen=seen: u.T @ sig(u @ w) / len(u) - seen.T @ sig(-seen @ w) / len(seen))
        scores = aside @ teller
        limits = np.unique(np.quantile(scores, np.linspace(0, 1, pu.LIMITS)))
        slack = np.sqrt(np.log(4 / pu.DOUBT) / 2) * (len(u) ** -0.5 + len(aside) ** -0.5)
        _, own = min(((np.mean(u @ teller >= c) + slack) / np.mean(scores >= c), np.mean(u @ teller >= c) / np.mean(scores >= c)) for c in limits)
        priors.append(min(max(own, 0.01), 0.99))
    prior = np.mean(priors)

    def risk_slope(w):
        good_part = prior * np.logaddexp(0, -p @ w).mean()
        rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        share = sig(np.clip(rest / pu.SOFTNESS, -60, 60))
        assert np.isfinite(good_part)
        return -prior * p.T @ sig(-p @ w) / len(p) + share * (u.T @ sig(u @ w) / len(u) - prior * p.T @ sig(p @ w) / len(p))

    want = put(x) @ descend(risk_slope)
    got = QUERIES["op3_quality_classifier"](spark, sf_dir).toPandas().set_index("doc_id").loc[docs.doc_id]
    apart = np.log(got.score / (1 - got.score)).to_numpy() - want  # the same but for the bias, which the prior sets
    assert np.abs(apart - np.median(apart)).max() < 0.35
    assert abs(got[is_open(docs.doc_id)].predicted.mean() - prior) < 0.03


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.9):
        good, rest = rng.normal(1.5, 1, 4000), np.concatenate([rng.normal(1.5, 1, int(20_000 * prior)), rng.normal(-2, 1, int(20_000 * (1 - prior)))])
        limits = np.unique(np.quantile(good, np.linspace(0, 1, 200)))
        found = positive_unlabelled.class_prior((rest[:, None] >= limits).sum(axis=0).astype(float), len(rest), good, limits)
        assert abs(found - prior) < 0.05


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(k, good(k)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    many = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1"))
    a, b = quality._features_of(docs.join(labels, "doc_id")), quality._features_of(many.join(labels, "doc_id"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
