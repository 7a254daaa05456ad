import zlib

import numpy as np
import pandas as pd

from statloom.llm import language
from statloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def table(spark):
    rows = [(k, ("the cat and the dog were in the house " if k % 2 else "der hund und die katze sind im haus ") * 3, "en" if k % 2 else "de", k) for k in range(40)]
    rows += [(100, None, "en", 0), (101, "", "de", 0), (102, "123 !?", "en", 0), (103, "the dog and the cat", None, 0), (103, "the dog and the cat", None, 0), (None, "die katze und der hund", "de", 0), (104, "die katze " * 20000, "de", 0), (105, "été", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def test_edges(spark):
    docs = table(spark)
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 48
    assert [by[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3
    assert by[103]["lang_pred"] == "en" and by[104]["lang_pred"] == "de" and by[None]["held_out"] is False and by[105]["lang_pred"] != "und"
    assert language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    kept = language.keep(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 45
    assert language.keep(docs, None, 0.5).count() == 45


def test_families_and_votes():
    rng = np.random.default_rng(1)
    names = np.array(["en", "de", "fr", "es", "it", "xx"], dtype=object)
    centre = rng.random((6, 40))
    x = np.vstack([centre[i] + 0.05 * rng.standard_normal((30, 40)) for i in range(6)]).astype(np.float32)
    y = np.repeat(names, 30)
    model = language.Model(x, y)
    got, scores = model.predict(x)
    assert (got == y).mean() > 0.95 and ((scores >= 0) & (scores <= 1)).all()
    one = language.Model(x[:30], y[:30])
    assert set(one.predict(x[:5])[0]) == {"en"}


def plain_features(text):
    """Square roots of the shares of hashed byte triples, counted one by one."""
    data, out = b" " + text.encode().lower() + b" ", np.zeros(language.WIDTH)
    for k in range(len(data) - 2):
        out[((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 % 2**32) >> (32 - language.BITS)] += 1
    return np.sqrt(out / (len(data) - 2))


def plain_machine(x, positive, steps=6000):
    """Squared hinge loss by plain gradient steps."""
    y, weight = np.where(positive, 1.0, -1.0), np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w += 0.5 * x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w)))
    return w


def test_against_brute_force(spark, sf_dir):
    """The query's languages are those of machines trained one by one on all open documents, at a size below the bound."""
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id])
    lettered = docs.text.notna() & docs.text.fillna("").str.contains(r"[^\W\d_]", regex=True)
    x = np.stack([plain_features(t) if ok else np.zeros(language.WIDTH) for t, ok in zip(docs.text, lettered, strict=True)])
    train = ~held & docs.lang.notna().to_numpy() & lettered.to_numpy()
    names = docs.lang.to_numpy(dtype=object)
    families = np.array([language.family(k) if isinstance(k, str) else None for k in names], dtype=object)
    top = {f: plain_machine(x[train], families[train] == f) for f in sorted(set(families[train]))}
    value = lambda w, v: v @ w[:-1] + w[-1]
    want = []
    pairs = {}
    for v, ok in zip(x, lettered, strict=True):
        if not ok:
            want.append("und")
            continue
        f = max(top, key=lambda k: value(top[k], v))
        own = sorted({n for n, g in zip(names[train], families[train], strict=True) if g == f})
        votes = dict.fromkeys(own, 0.0)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                some = train & ((names == a) | (names == b))
                w = pairs.get((a, b))
                if w is None:
                    w = pairs[a, b] = plain_machine(x[some], names[some] == a)
                won = 1 / (1 + np.exp(-4 * value(w, v)))
                votes[a] += won
                votes[b] += 1 - won
        want.append(max(votes, key=votes.get))
    got = QUERIES["op6_language_id"](spark, sf_dir).toPandas().set_index("doc_id").lang_pred
    assert np.mean([got[i] == k for i, k in zip(docs.doc_id, want, strict=True)]) >= 0.99


def test_an_id_in_many_rows_leaves_its_language_the_others(spark, monkeypatch):
    words = {"en": "the of and house water", "fr": "le la été maison eau"}
    rows = [(k, f"{words[lang]} {lang}{k}", lang) for k in range(100) for lang in [("en", "fr")[k % 2]]]
    rows += [(2, "the of and house water en2", "en")] * 900
    seen = []
    monkeypatch.setattr(language, "Model", lambda x, langs: seen.append(list(langs)))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30)
    assert seen[0].count("en") == 30 and seen[0].count("fr") == 30
