"""Language identification in two steps.

Linear support vector machines tell the language family first; within it, machines for each pair of its languages vote.
Features are the square roots of the shares of hashed byte triples of the ASCII-lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.base import fold, raw, uniform

FOLDS, HELD_OUT = 5, 0
#: Bound of the training sample for each language.
MOST_PER_LANGUAGE = 800
BITS = 11
WIDTH = 1 << BITS
UNDETERMINED = "und"
SEED = 6
STEPS = 150
#: Families by language code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def family(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def features(text: bytes) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.float32)
    b = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    triples = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    out[:] = np.sqrt(np.bincount(triples, minlength=WIDTH) / len(triples))
    return out


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or _LETTER.search(text.decode("utf-8", "replace")) is not None)


def support_vector_machine(x: np.ndarray, positive: np.ndarray, steps: int = STEPS, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, both classes weighing the same."""
    y = np.where(positive, 1.0, -1.0).astype(x.dtype)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(x.dtype)
    w = np.zeros(x.shape[1] + 1, dtype=x.dtype)
    look, last = w.copy(), 1.0
    rate = float(1 / (2 * (weight @ (np.einsum("ij,ij->i", x, x) + 1)) + ridge))  # the loss is at most that curved
    for _ in range(steps):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        g = -2 * weight * y * slack
        new = look - rate * np.append(x.T @ g + ridge * look[:-1], g.sum())
        now = (1 + (1 + 4 * last * last) ** 0.5) / 2
        look, w, last = new + (last - 1) / now * (new - w), new, now
    return w


class Model:
    """families: names; the machines' weights by column, one for each family, and one for each pair within a family."""

    def __init__(self, x: np.ndarray, languages: np.ndarray):
        self.families = sorted({family(k) for k in languages})
        self.members = {f: sorted({k for k in languages if family(k) == f}) for f in self.families}
        own = np.array([family(k) for k in languages], dtype=object)
        first = support_vector_machine(x, own == self.families[0]) if len(self.families) == 2 else None
        self.top = None
        if first is not None:
            self.top = np.stack([first, -first], axis=1)
        elif len(self.families) > 2:
            self.top = np.stack([support_vector_machine(x, own == f) for f in self.families], axis=1)
        self.pairs = {(a, b): support_vector_machine(x[(languages == a) | (languages == b)], languages[(languages == a) | (languages == b)] == a) for f in self.families for a, b in combinations(self.members[f], 2)}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores: the family's share of a softmax over families, times the mean win in the pairs."""
        n = len(x)
        sure = np.ones(n)
        at = np.zeros(n, dtype=np.int64)
        if self.top is not None:
            z = 4 * (x @ self.top[:-1] + self.top[-1])
            at = z.argmax(axis=1)
            sure = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        languages, scores = np.empty(n, dtype=object), np.zeros(n)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(at == i)
            names = self.members[f]
            if len(names) == 1:
                languages[rows], scores[rows] = names[0], sure[rows]
                continue
            wins = np.zeros((len(rows), len(names)))
            for (a, b), w in self.pairs.items():
                if a in names:
                    won = 1 / (1 + np.exp(-np.clip(4 * (x[rows] @ w[:-1] + w[-1]), -60, 60)))
                    wins[:, names.index(a)] += won
                    wins[:, names.index(b)] += 1 - won
            best = wins.argmax(axis=1)
            languages[rows] = np.array(names, dtype=object)[best]
            scores[rows] = sure[rows] * wins.max(axis=1) / (len(names) - 1)
        return languages, np.clip(scores, 0, 1)


def fit(docs: DataFrame, most: int = MOST_PER_LANGUAGE) -> Model | None:
    """A model from at most `most` documents of each language outside the held-out fold, those of smallest hash."""
    rows = docs.where("lang is not null and text is not null").where(F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False)))
    # per language about twice the ids wanted are left by their hash; only these are ranked, each once
    own = F.xxhash64(F.lit(SEED), "doc_id")
    share = rows.groupBy("lang").agg(F.greatest(F.lit(1), F.approx_count_distinct("doc_id", 0.02)).alias("n")).select("lang", (F.lit(2.0 * most + 300.0) / F.col("n")).alias("share"))
    # one row per language, far less than the model holds of it; a shuffled join would gather a language's ids in one task
    thinned = rows.select("doc_id", "lang").join(F.broadcast(share), "lang").where(uniform(own) < F.col("share")).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(own, "doc_id"))
    wanted = thinned.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([features(t).tobytes() if has_letter(t) else None for t in texts], pa.binary())], names=["doc_id", "lang", "features"])

    told = rows.select("doc_id", "lang", "text").join(F.broadcast(wanted), ["doc_id", "lang"]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, features binary")
    # an id that many rows repeat counts once
    got = told.where("features is not null").groupBy("doc_id", "lang").agg(F.min("features").alias("features")).select("lang", "features").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "features"], kind="stable")
    x = np.frombuffer(b"".join(got["features"]), dtype=np.float32).reshape(-1, WIDTH)
    return Model(x, got["lang"].to_numpy())


def _predicted(texts: list[bytes | None], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of a batch of texts."""
    languages, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    told = [i for i, t in enumerate(texts) if model and has_letter(t)]
    for k in range(0, len(told), 2048):
        part = told[k : k + 2048]
        languages[part], scores[part] = model.predict(np.stack([features(texts[i]) for i in part]).astype(np.float64))
    return languages, scores


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    A null text, and one without a letter, is `und` with score 0, as is everything without a model. A null doc_id is
    not held out. Rows that repeat get one prediction each; an empty table gives an empty result; further columns are
    ignored. Whole texts are read, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages, scores = _predicted(raw(b.column("text")), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not `und` and scores at least `least`.

    Without a model (no labelled text) only rows without a letter go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw(b.column("text"))
            if sent.value is None:
                yield b.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
            else:
                languages, scores = _predicted(texts, sent.value)
                yield b.filter(pa.array((languages != UNDETERMINED) & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
