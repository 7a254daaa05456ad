import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = packing.WordTokens(PATH)
REFERENCE = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbé ñ.,;:!?'s ́ \n\t1#ΣS", max_size=40))
def test_tokens_are_those_of_the_whole_text(text):
    assert WORDS.ids(text.encode()).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_is_one_path():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_rebuild_the_documents(spark, length):
    texts = ["hello world", None, "", "the same text again", "the same text again", "word " * 5000, "don't stop!", "the same text again"]
    rows = [(i if i < 7 else 3, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    pieces = packing.pack(df, PATH, length).collect()
    ids = defaultdict(list)
    for d, t, _ in rows:
        ids[d].append(np.array([*REFERENCE.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    sequences = defaultdict(list)
    seen = defaultdict(Counter)
    for p in pieces:
        own = ids[p["doc_id"]][0]
        part = own[p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0 and p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(part.tobytes())
        seen[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all(seen[d] == Counter({k: len(v) for k in range(len(v[0]))}) for d, v in ids.items())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    assert packing.pack(df.limit(0), PATH, length).count() == 0
