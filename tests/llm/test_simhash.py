import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from statloom.llm import simhash
from statloom.llm.base import dealt


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="abÀÉ \n\t", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute(text)


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("common", [2, 192])
def test_links_keep_all_connections(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)] + [(1 << 64) - 1, 0]
    values = set(base)
    for b in base[:12]:
        for k in (1, 2, 3, 4, 5, 6):
            for _ in range(3):
                v = b
                for bit in rng.choice(64, k, replace=False):
                    v ^= 1 << int(bit)
                values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    true = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4]
    assert {tuple(sorted(e)) for e in got} <= set(true)
    if common == 192:
        assert sorted(tuple(sorted(e)) for e in got) == sorted(true)  # each link once
    assert roots(signed, got) == roots(signed, true)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (-5, 40), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert all(got.get(n, n) == r for n, r in roots(nodes, edges).items())
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_operator(spark):
    text = " ".join(f"w{i}" for i in range(300))
    near = text.replace("w150 ", "v150 ")
    docs = [(5, text, 1), (3, text.upper(), 1), (8, near, 1), (9, "other words entirely here now", 1), (2, None, 1), (4, "", 1), (None, "  ", 1), (9, "other words entirely here now", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp long")
    rows = simhash.near_duplicates(df).collect()
    prints = {d: brute(t) for d, t, _ in docs}
    assert len(rows) == 8
    for r in rows:
        mine = prints[r["doc_id"]]
        assert r["fingerprint"] == f"{mine:016x}"
        close = [d for d, p in prints.items() if d is not None and bin(p ^ mine).count("1") <= 4]
        assert r["component_id"] == min(close)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in rows})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_first_with_clashing_columns(spark):
    rows = [(1, "some words that are here twice", "r", 7), (1, "some words that are here twice", "r", 8), (2, "quite other words over there today", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, rank int").withColumn("_rank", F.col("rank"))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and all(r["rank"] == r["_rank"] for r in got)


def test_rows_are_dealt_before_the_variants(spark):
    nodes = spark.range(1000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    plan = dealt(nodes.select("fp"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
