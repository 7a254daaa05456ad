import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(sums[k][0] for k in kids[node]) or 1, mine + sum(sums[k][1] for k in kids[node]))
    return sorted(
        (min(c for c, _ in m), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(m), len(kids[node]), *sums[node],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(node))).encode()).hexdigest())
        for node, m in members.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_rows(seed, convs, longest, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, convs * 2), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if turn % 3 else "user", rng.choice(["a", "bé", "", None, "long text"][:kinds])))
    return rows


@pytest.mark.parametrize("local,chunk,longest", [(4, 4, 14), (512, 64, 8), (6, 3, 30)])
def test_any_sizes_of_buckets_and_rows(spark, monkeypatch, local, chunk, longest):
    monkeypatch.setattr(prefix_trie, "LOCAL_TURNS", local)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "STEP", 5)
    rows = random_rows(local, 40, longest, 2) + [(500 + k, t, "user", "same") for k in range(12) for t in range(4)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hard_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "a", "x"), (3, 7, "user", ""), (4, 1, "", "user"), (None, 1, "user", "lost"), (7, 2, "u", "é" * 50_000), (5, 1, "ab", "c"), (6, 1, "a", "bc")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, conv long")
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_one_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(10, t, "user", f"turn {t % 7}") for t in range(40)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=12))
def test_quicksort_finds_every_node(tails):
    members = [(c, [9, *t], [1] * (len(t) + 1)) for c, t in enumerate(tails)]
    nodes = prefix_trie.quicksorted(members, 3, -7)
    seen = defaultdict(list)
    for c, ids, _ in members:
        for d in range(1, len(ids) + 1):
            seen[tuple(ids[:d])].append(c)
    assert sorted((n[0], n[1], n[3]) for n in nodes) == sorted((min(m), 2 + len(k), len(m)) for k, m in seen.items())
    assert nodes[0][2] == -7 and nodes[0][5] == sum(all(k != o[: len(k)] or k == o for o in seen) for k in seen)


def test_query(spark, sf_dir):
    from statloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, sf_dir)) == brute(rows)
