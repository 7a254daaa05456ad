import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statloom.llm import alignment
from statloom.llm.queries import ALIGNED, QUERIES

A_PATH, B_PATH = map(P.path, ALIGNED)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment.Encoder(P.path("byte_bpe_50k.json"))


def pieces(coders, text):
    """Ids with their byte ranges on both sides, or nothing."""
    a, b, spelled = coders
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    own = []
    for k in ids_b:
        name = b.id_to_piece(k)
        own.append(bytes([int(name[3:5], 16)]) if b.is_byte(k) else name.replace("▁", " ").encode())
    out = []
    for ids, words in ((ids_a, [spelled.spelled[k] for k in ids_a]), (ids_b, own)):
        if b"".join(words) != (" " + text).encode():
            return [], []
        at, found = 0, []
        for k, w in zip(ids, words):
            found.append((k, at, at + len(w)))
            at += len(w)
        out.append(found)
    return tuple(out)


def brute(coders, rows):
    links, counts, told = [], defaultdict(int), []
    for doc_id, text in rows:
        a, b = pieces(coders, text)
        own = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
        links.append(own)
        for pair in set(own):
            counts[pair] += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(k) for k, s, e in side if s >= low and e <= high) for side in (a, b)))
            low = high
        told.append([doc_id, len(a), len(b), len(ends), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = [(*t[:5], sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), t[5]) for t, own in zip(told, links)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


HARD = [
    (1, "Hello world, hello  world"), (2, ""), (3, None), (4, "naïve café 東京 🎉"), (5, "<|endoftext|> <s> </s> <0x41> ▁"), (6, "\n\t  tabs\r\n"), (7, " "), (8, "\x00\x01"),
    (9, "Hello world, hello  world"), (9, "Hello world, hello  world"), (None, "Hello"), (10, "aaaa" * 300 + " " * 200), (11, "é ﬁ ™ ½"), (12, " x"),
]


def test_hard_cases(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 40)
    df = spark.createDataFrame([(*r, 0, "x") for r in HARD], "doc_id long, text string, block long, pairs string").coalesce(2)
    assert got(alignment.align(df, A_PATH, B_PATH, P.PATTERN)) == brute(coders, HARD)
    assert got(alignment.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH, P.PATTERN)) == []


def test_query(spark, sf_dir, coders):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert got(alignment.align(df, A_PATH, B_PATH, P.PATTERN)) == brute(coders, short)
    whole = got(QUERIES["op12_alignment"](spark, sf_dir))
    assert len(whole) == len(rows)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_files_of_a_vocabulary_give_the_same_ids(text):
    ranks, words = test_both_files_of_a_vocabulary_give_the_same_ids.coders
    assert ranks.encode(text).tolist() == words.encode(text).tolist()


test_both_files_of_a_vocabulary_give_the_same_ids.coders = (alignment.Encoder(A_PATH, P.PATTERN), alignment.Encoder(P.path("byte_bpe_50k.json")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_links_and_groups_of_any_lengths(a, b):
    a, b = [*a, max(0, sum(b) - sum(a))], [*b, max(0, sum(a) - sum(b))]
    a, b = np.array([x for x in a if x]), np.array([x for x in b if x])
    x = alignment.Aligned(a, b)
    ranges = [[(e - n, e) for n, e in zip(side, np.cumsum(side))] for side in (a, b)]
    assert list(zip(*(c.tolist() for c in x.links()))) == [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (f, g) in enumerate(ranges[1]) if s < g and f < e]
    assert x.ends.tolist() == sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})


def test_groups(spark, coders):
    row = alignment.groups(spark.createDataFrame([(1, "Hello café")], "doc_id long, text string"), A_PATH, B_PATH, P.PATTERN).first()
    a, b = pieces(coders, "Hello café")
    assert sum(row["a_ids"], []) == [k for k, *_ in a] and sum(row["b_ids"], []) == [k for k, *_ in b] and row["ends"][-1] == len(" Hello café".encode())
