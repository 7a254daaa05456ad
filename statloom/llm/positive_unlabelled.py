"""Quality classifier from positive and unlabelled documents.

A linear model over features of style and byte pairs minimises the non-negative unbiased risk: pi * R+(positives) plus
max(0, R-(unlabelled) - pi * R-(positives)), with logistic loss. Positives are labelled documents of good quality, all
other labels are unknown to it. With a linear model both branches of the maximum are convex; a soft maximum of them is
minimised by Newton steps, for which every step sums the unlabelled risk and its slopes over all rows in Spark.

The class prior pi comes from the same two sets: a model that tells positives from unlabelled rows scores both, and pi
is the least ratio, over all limits, of the share of unlabelled rows above a limit to that of positives kept aside. Each
half of the positives is kept aside once. The share of rows that score 0.5 or more is the prior as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.base import bounded_sample, fold, raw, stash
from statloom.llm.quality import FEATURES, statistics

FOLDS, HELD_OUT = 3, 1
#: Bound of the sample of labelled rows.
MOST_POSITIVE = 15_000
#: Rows that the steps' curvature is taken from; slopes come from all rows, so these only set the steps' lengths.
CURVATURE_ROWS = 4_000
HASHED = 128
STEPS = 20
#: Steps end when one betters the risk by no more than this.
LEAST_GAIN = 1e-5
#: Shares of a Newton step that one pass over the rows tries.
TRIED = (1.0, 0.5, 0.2, 0.05)
RIDGE = 1e-3
#: Sharpness of the soft maximum.
SOFTNESS = 0.005
#: Limits that the prior is sought over, and the chance that its bounds fail.
LIMITS = 200
DOUBT = 0.1
#: Used where nothing is labelled good.
DEFAULT_PRIOR = 0.85
SEED = 3
WIDTH = len(FEATURES) + 1 + HASHED


def features(text: bytes | None) -> np.ndarray:
    """Style statistics, log length, and the square roots of the shares of hashed byte pairs."""
    text = text or b""
    counts, style = statistics(text)
    out = np.zeros(WIDTH, dtype=np.float32)
    out[: len(style)] = np.sqrt(style)
    out[len(style)] = np.log1p(counts[0])
    if len(text) > 1:
        b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        pairs = ((b[:-1] * np.uint32(256) + b[1:]) * np.uint32(2654435761)) >> np.uint32(25)
        out[len(style) + 1 :] = np.sqrt(np.bincount(pairs, minlength=HASHED) / len(pairs))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the bias comes last

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((rows - self.mean) / self.scale, -8, 8), np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(rows) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


Slopes = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def newton(unlabelled: Slopes, curvature: np.ndarray, objectives: list[Callable], steps: int = STEPS) -> list[np.ndarray]:
    """Weights of least objective(weights, risk, slopes, curvature rows) -> (value, slopes, curvature), for each of them.

    unlabelled(W) gives mean logistic loss and slopes over all unlabelled rows for each column of W, in one pass, in
    which all objectives take their next step. curvature: inputs of some of these rows.
    """
    width, tries = curvature.shape[1], len(TRIED)
    weights = [np.zeros(width) for _ in objectives]
    risk, slope = unlabelled(np.zeros((width, 1)))
    state = [f(w, risk[0], slope[:, 0], curvature) for f, w in zip(objectives, weights, strict=True)]
    active = list(range(len(objectives)))
    for _ in range(steps):
        tried = np.hstack([weights[i][:, None] + np.linalg.solve(state[i][2], -state[i][1])[:, None] * np.array(TRIED) for i in active])
        risk, slope = unlabelled(tried)
        going = []
        for j, i in enumerate(active):
            found = [objectives[i](tried[:, k], risk[k], slope[:, k], curvature) for k in range(j * tries, (j + 1) * tries)]
            k = int(np.argmin([f[0] for f in found]))
            gain = state[i][0] - found[k][0]
            if gain > 0:
                weights[i], state[i] = tried[:, j * tries + k], found[k]
                if gain > LEAST_GAIN:
                    going.append(i)
        active = going
        if not active:
            break
    return weights


def _ridge(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    own = np.full(len(w), RIDGE)
    own[-1] = 1e-6
    return float(own @ (w * w)) / 2, own * w, np.diag(own)


def _bend(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean curvature of the logistic loss."""
    s = _sigmoid(x @ w)
    return (x * (s * (1 - s))[:, None]).T @ x / len(x)


def telling(positive: np.ndarray) -> Callable:
    """Objective of a model that tells positives from unlabelled rows, both sets weighing the same."""

    def objective(w: np.ndarray, risk: float, slope: np.ndarray, rows: np.ndarray):
        z, (r, rg, rh) = positive @ w, _ridge(w)
        return _soft(-z).mean() + risk + r, slope - positive.T @ _sigmoid(-z) / len(z) + rg, _bend(rows, w) + _bend(positive, w) + rh

    return objective


def non_negative(positive: np.ndarray, prior: float) -> Callable:
    """Objective of the non-negative risk: a soft maximum of the unbiased risk and of its positive part alone."""
    mean = positive.mean(axis=0)

    def objective(w: np.ndarray, risk: float, slope: np.ndarray, rows: np.ndarray):
        z, (r, rg, rh) = positive @ w, _ridge(w)
        part = prior * _soft(-z).mean()
        part_slope = -prior * positive.T @ _sigmoid(-z) / len(z)
        whole, whole_slope = risk - prior * z.mean(), slope - prior * mean
        top = max(whole, part)
        share = float(_sigmoid(np.array((whole - part) / SOFTNESS)))
        value = top + SOFTNESS * np.log1p(np.exp(-abs(whole - part) / SOFTNESS))
        turn = whole_slope - part_slope
        bend = share * _bend(rows, w) + (1 - share) * prior * _bend(positive, w) + share * (1 - share) / SOFTNESS * np.outer(turn, turn)
        return value + r, share * whole_slope + (1 - share) * part_slope + rg, bend + rh

    return objective


def class_prior(above: np.ndarray, rows: int, positives: np.ndarray, limits: np.ndarray) -> float:
    """The least ratio of shares above a limit, at the limit whose upper bound is least.

    above: unlabelled rows that score at least each limit; positives: scores of positives that trained no model.
    """
    of_all = above / rows
    of_good = (positives[:, None] >= limits[None, :]).mean(axis=0)
    slack = np.sqrt(np.log(4 / DOUBT) / 2) * (1 / np.sqrt(rows) + 1 / np.sqrt(len(positives)))
    sound = of_good > 0
    bound = np.where(sound, (of_all + slack) / np.where(sound, of_good, 1), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(of_all[k] / of_good[k], 0.01, 0.99))


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of part(features) over all rows, `width` numbers, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column("features")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(width)
    for r in rows.select("features").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def _chosen(rows: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the rows with these ids, in a fixed order; of rows that repeat an id, one."""
    got = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features")).toPandas().sort_values("doc_id", kind="stable")
    return _matrix(pa.array(got["features"], pa.binary()))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """A model from rows (doc_id, features) outside the held-out fold and the labels of documents in these rows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    good = known.groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select("doc_id")
    sums = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * WIDTH)
    n, positive = int(sums[0]), _chosen(rows, bounded_sample(good, "doc_id", MOST_POSITIVE, SEED))
    if not n or len(positive) < 2:
        blank = np.zeros(WIDTH + 1)
        blank[-1] = np.log(DEFAULT_PRIOR / (1 - DEFAULT_PRIOR))
        return Model(np.zeros(WIDTH), np.ones(WIDTH), blank)
    mean = sums[1 : 1 + WIDTH] / n
    scale = np.sqrt(np.maximum(sums[1 + WIDTH :] / n - mean * mean, 0)) + 1e-6
    base = Model(mean, scale, np.zeros(WIDTH + 1))

    def unlabelled(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = w.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            x = base.inputs(x)
            z = x @ w
            return np.concatenate([_soft(z).sum(axis=0), (x.T @ _sigmoid(z)).ravel()])

        total = _summed(rows, part, k + k * (WIDTH + 1)) / n
        return total[:k], total[k:].reshape(WIDTH + 1, k)

    some = base.inputs(_chosen(rows, bounded_sample(rows.select("doc_id").where("doc_id is not null").distinct(), "doc_id", CURVATURE_ROWS, SEED + 1)))
    good_inputs = base.inputs(positive)
    order = np.random.default_rng(SEED).permutation(len(positive))
    halves = order[: len(order) // 2], order[len(order) // 2 :]

    def above(w: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """How many of all rows lie at or above each limit."""
        return _summed(rows, lambda x: (base.inputs(x) @ w >= limits[:, None]).sum(axis=1).astype(float), len(limits))

    tellers = newton(unlabelled, some, [telling(good_inputs[h]) for h in halves])
    scores = [good_inputs[halves[1 - k]] @ w for k, w in enumerate(tellers)]
    limits = [np.unique(np.quantile(x, np.linspace(0, 1, LIMITS))) for x in scores]
    prior = float(np.mean([class_prior(above(w, c), n, x, c) for w, c, x in zip(tellers, limits, scores, strict=True)]))
    (w,) = newton(unlabelled, some, [non_negative(good_inputs, prior)])
    # the bias moves so that the share of all rows that score 0.5 or more is the prior
    limits = np.unique(np.quantile(np.concatenate([some @ w, good_inputs @ w]), np.linspace(0, 1, 4 * LIMITS)))
    w[-1] -= limits[int(np.argmin(np.abs(above(w, limits) / n - prior)))]
    return Model(mean, scale, w)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts get the score of an empty text. Labels that are null or contradict each other are not used;
    with fewer than two positive labels every score is the default prior. A null doc_id is never held out. Rows that
    repeat are scored each, and each counts as unlabelled; an empty table gives an empty result; further columns are
    ignored.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([features(t).tobytes() for t in raw(b.column("text"))], pa.binary())], names=["doc_id", "held_out", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows, _ = stash(docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(describe, f"doc_id {kind}, held_out boolean, features binary"), "features")
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~F.col("held_out")), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = sent.value.score(_matrix(b.column("features")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
