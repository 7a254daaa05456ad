import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import mixing


def table(spark, sizes):
    rows = [(i, None if n is None else " ".join(f"w{i}_{k}" for k in range(n)), s, "taken") for i, (n, s) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


def fill(sizes, weights=(5.0, 2.0, 1.0), most=3):
    w = np.array([weights[i % 3] for i in range(len(sizes))])
    s, capped = np.array(sizes, dtype=float), np.zeros(len(sizes), dtype=bool)
    while True:
        left = s.sum() - most * s[capped].sum()
        target = np.where(capped, most * s, left * w / max(w[~capped].sum(), 1e-300))
        new = ~capped & (target > most * s)
        if not new.any():
            return target
        capped |= new


@pytest.mark.parametrize("sizes", [[100, 20, 5, 900], [1, 1000, 1, 1], [10, 10, 10], [7], [0, 50, 0, 3]])
def test_targets(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    rows = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    got = {r["source"]: r["target"] for r in rows}
    assert np.allclose([got[n] for n in names], fill(sizes))


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        got = [r["p"] for r in df.collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != sorted(got)


def test_running_total_over_parts(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    rows = mixing.running_total(df, ["g"], ["id"], "v", "start", 9).collect()
    for g in range(3):
        own = sorted((r["start"], r["v"]) for r in rows if r["g"] == g)
        at = 0
        for start, v in sorted(own, key=lambda x: (x[0], x[1] > 0)):
            assert start == at
            at += v


def test_mix(spark):
    sizes = [(300, "a")] * 30 + [(50, "b")] * 20 + [(None, "a"), (0, "c"), (40, None), (2000, None), (1, "d")]
    df = table(spark, sizes)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(sizes)
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        s = sizes[r["doc_id"]][1]
        assert r["size"] == (sizes[r["doc_id"]][0] or 0) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS + 0.01 * target[s]
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_applied_mix_has_the_words_taken(spark):
    sizes = [(300, "a")] * 6 + [(90, "b")] * 5 + [(None, "a"), (33, None)]
    df = table(spark, sizes).withColumn("n_chars", F.length("text").cast("long"))
    df = df.union(df.where("doc_id = 2"))  # an id that repeats
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got, whole = defaultdict(int), {r["doc_id"]: r["text"] for r in df.collect()}
    for r in out.collect():
        words = r["text"].split(" ")
        got[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"])
        assert [w for w in whole[r["doc_id"]].split(" ") if w in set(words)] == words
    assert got == {k: v for k, v in want.items() if v}


def test_word_count(spark):
    texts = ["a b", " a\tb\n c\x0b ", "\u2003", None, "", "é\u00a0ü x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


SOURCES = [(1, 32 * 600, 32 * 1800.0), (2, 32 * 4000, 32 * 3000.0), (3, 32 * 5000, 32 * 215.0), (4, 0, 0.0)]


def test_shards_draw_their_counts(spark):
    """Shards are equal in size, a count is its sure part and draws, and the draws' totals stand near the targets."""
    sources = spark.createDataFrame(SOURCES, "source_id long, source_size long, target double")
    rows = mixing.slots(sources, 32, 50).toPandas()
    share = np.array([1800, 3000, 215])
    counts = rows.groupby(["shard", "source_id"]).size().unstack(fill_value=0)
    assert len(counts) == 101 and counts.sum(axis=1).between(48, 50).all()  # a full source has no slots beyond its passes
    sure = np.floor(share * 50 / share.sum())
    drawn = counts.to_numpy() - sure
    assert (drawn >= -1).all() and (drawn[:, 1:] >= 0).all() and drawn[:, 1].std() > 0.3
    assert np.all(np.abs(counts.sum().to_numpy() - share) <= 3 * np.sqrt(101) / 2 + 40)
    assert rows.groupby("source_id").slot.apply(lambda x: sorted(x) == list(range(len(x)))).all()
    assert rows[rows.source_id == 1].groupby("block").size().max() <= 3 and rows[rows.source_id == 2].block.is_unique


def test_draws_decide_the_rows(spark):
    df = table(spark, [(300, "a")] * 60 + [(90, "b")] * 40 + [(500, "c")] * 20)
    told, target = {}, {"a" if r["doc_id"] < 60 else "b" if r["doc_id"] < 100 else "c": r["target"] for r in mixing.mix(df).collect()}
    for shard_slots, seed in ((50, 7), (50, 8), (20, 7)):
        rows = mixing.shard_pieces(df, shard_slots=shard_slots, seed=seed).toPandas()
        told[shard_slots, seed] = {tuple(r) for r in rows[["doc_id", "first", "slot"]].itertuples(index=False)}
        words = rows.groupby("source").words.sum()
        assert all(abs(words[s] - target[s]) <= 3 * 32 * np.sqrt(rows.shard.nunique()) + 64 for s in target)
        assert (rows.groupby(["shard", "source", "slot"]).words.sum() <= 32).all()
    taken = [sorted((d, f) for d, f, _ in told[k]) for k in ((50, 7), (50, 8), (20, 7))]
    assert taken[0] != taken[1] and taken[0] != taken[2]


def test_applied_mix_with_clashing_columns(spark):
    df = table(spark, [(300, "a")] * 4 + [(90, "b")] * 3)
    names = ["parts", "row", "copy", "size", "mixed", "own_id", "row_id", "_doc_id", "_text"]
    odd = df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in mixing.apply_mix(df).collect())


def test_rows_without_ids(spark):
    df = table(spark, [(50, "a")] * 4).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.mix(df.union(df)).collect()
    assert len(rows) == 8 and sum(r["taken"] for r in rows) >= 0.8 * 400
