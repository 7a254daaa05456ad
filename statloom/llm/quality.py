"""Quality rules: per-document rule statistics, two fixed rules and an isolation forest over the statistics.

The forest is fitted on a bounded sample of labelled documents of good quality; documents with short average path
lengths are unlike them. The score limit is calibrated on all labelled rows, counted by score bin in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.base import bounded_sample, raw

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

#: Parameters of the forest: bound of the labelled sample, trees, rows per tree.
MOST_LABELLED = 20_000
TREES = 128
ROWS_PER_TREE = 256
#: Scores (0 to 1) are counted in so many bins of equal width.
BINS = 1 << 16
#: Splits may lie this many standard deviations outside a node's rows, so a column in which all good rows agree still counts.
STEP = 1.0
SEED = 9

_UPPER = re.compile(rb"[A-Z]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_chars", "symbols", "dup_lines", "repeats", "upper", "marks", "top_word")


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window which occurs at least twice."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    if distinct < 1 << 21:
        codes = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        codes = pairs * distinct + ids[2:]
    _, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + n] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """STATS and FEATURES of one whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = sum(joined.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    repeats = _repeated(ids, len(known))
    codes = np.bincount(np.frombuffer(joined, dtype=np.uint8), minlength=128) if joined else np.zeros(128, dtype=np.int64)
    top = int(np.bincount(ids).max()) if n else 0
    d, c = max(n, 1), max(len(joined), 1)
    features = [chars / d, symbols / d, dup / max(lines, 1), repeats / d, codes[65:91].sum() / c, (codes[33] + codes[63]) / d, top / d]
    return [n, chars, symbols, dup, repeats], features


def _path_constant(n: np.ndarray | float):
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.maximum(np.asarray(n, dtype=float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: split column (-1 at a leaf), split value, children, path length at a leaf."""

    def __init__(self, rows: np.ndarray, scale: np.ndarray, trees: int = TREES, per_tree: int = ROWS_PER_TREE, seed: int = SEED):
        """scale: what counts as a small step in each column; splits may lie so far outside the rows of a node."""
        rng = np.random.default_rng(seed)
        per_tree = min(per_tree, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), per_tree, replace=False)], scale, rng) for _ in range(trees)]
        self.norm = max(float(_path_constant(per_tree)), 1e-9)

    @staticmethod
    def _grow(rows: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = 2 * int(np.ceil(np.log2(max(len(rows), 2))))
        column, value, left, right, length = [], [], [], [], []
        todo = [(rows, 0, -1, False)]
        while todo:
            part, depth, parent, is_right = todo.pop()
            me = len(column)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            low, high = part.min(axis=0) - scale, part.max(axis=0) + scale
            free = np.flatnonzero(high > low)
            for a, x in ((column, -1), (value, 0.0), (left, me), (right, me), (length, depth + float(_path_constant(len(part))))):
                a.append(x)
            if depth < limit and len(part) > 1 and len(free):
                c = int(rng.choice(free))
                v = rng.uniform(low[c], high[c])
                column[me], value[me] = c, v
                goes = part[:, c] < v
                if goes.all() or not goes.any():  # the empty side is a leaf of no rows
                    empty = len(column)
                    for a, x in ((column, -1), (value, 0.0), (left, empty), (right, empty), (length, float(depth + 1))):
                        a.append(x)
                    (right if goes.all() else left)[me] = empty
                    todo.append((part, depth + 1, me, not goes.all()))
                else:
                    todo += [(part[goes], depth + 1, me, False), (part[~goes], depth + 1, me, True)]
        return np.array(column), np.array(value), np.array(left), np.array(right), np.array(length)

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / usual path length): near 1 for anomalies."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for column, value, left, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                c = column[at]
                if (c < 0).all():
                    break
                go_left = rows[each, np.maximum(c, 0)] < value[at]
                at = np.where(c < 0, at, np.where(go_left, left[at], right[at]))
            total += length[at]
        return np.exp2(-total / len(self.trees) / self.norm)


def calibrate(scores: np.ndarray, good: np.ndarray, n: np.ndarray | None = None) -> float:
    """The limit with the highest balanced accuracy, good documents weighing four times as much as bad ones.

    Scores up to the limit are kept. Ties go to the higher limit; without bad rows nothing is anomalous. n: rows that
    each score stands for.
    """
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    n = np.ones(len(s)) if n is None else n[order]
    kept_good, kept_bad = np.cumsum(n * g) / (n * g).sum(), np.cumsum(n * ~g) / (n * ~g).sum()
    gain = 4 * kept_good - kept_bad
    gain[:-1][s[1:] == s[:-1]] = -np.inf  # a limit lies between different scores
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float("inf")


_STAT_SCHEMA = ", ".join(f"{s} long" for s in STATS)


def _features_of(docs: DataFrame) -> DataFrame:
    """quality, features of each row of (doc_id, text, quality); of rows that repeat an id, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t)[1] for t in raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    each = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, features array<double>")
    return each.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features"))


def _score_counts(docs: DataFrame, known: DataFrame, forest: Forest) -> DataFrame:
    """quality, bin, n: all rows of docs (doc_id, text) with a label in known that the fixed rule on repeats leaves, by
    bin of their score.

    Rows are scored before they meet the labels, so that only ids and bins are shuffled, never texts; then they are
    counted by id, so that a repeated id is one row of the join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([statistics(t)[1] for t in raw(b.column("text"))])
            sound = x[:, FEATURES.index("repeats")] * 100 <= MAX_REPEAT_PERCENT
            at = np.minimum(sent.value.anomaly(x) * BINS, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at)], names=["doc_id", "bin"]).filter(pa.array(sound))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, bin long")
    counted = scored.groupBy("doc_id", "bin").agg(F.count("*").alias("n"))
    return counted.join(known, "doc_id").groupBy("quality", "bin").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, seed: int = SEED) -> tuple[Forest | None, float]:
    """Forest from at most `most` labelled rows, those with the smallest hash of doc_id; limit from all labelled rows.

    Labels that are null or that contradict each other for one document are left out. Without any good row there is no
    forest, and the fixed rules decide alone.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("top")).where("quality = top").drop("top")
    sample = bounded_sample(known, "doc_id", most, seed)
    texts = docs.select("doc_id", "text")
    rows = _features_of(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")).toPandas()
    if not (rows["quality"] == 1).any():
        return None, float("inf")
    x, good = np.stack(rows["features"].to_numpy()), (rows["quality"] == 1).to_numpy()
    order = np.lexsort((*x.T, good))  # the sample's order depends on Spark's partitions
    x, good = x[order], good[order]
    forest = Forest(x[good], STEP * x.std(axis=0), seed=seed)
    counts = _score_counts(texts, known, forest).toPandas()
    at, is_good, n = counts["bin"].to_numpy(), (counts["quality"] == 1).to_numpy(), counts["n"].to_numpy(dtype=float)
    limit = calibrate(at.astype(float), is_good, n)
    return forest, (np.floor(limit) + 1) / BINS if np.isfinite(limit) else limit


def _verdicts(texts: list[bytes | None], trees: Forest | None, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """STATS, base_failed, anomaly and kept of a batch of texts."""
    both = [statistics(t) for t in texts]
    stats = np.array([x[0] for x in both], dtype=np.int64)
    failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
    score = trees.anomaly(np.array([x[1] for x in both])) if trees else np.zeros(len(both))
    return stats, failed, score, ~failed & (score <= limit)


def judge(docs: DataFrame, forest: Forest | None, limit: float) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly (0 to 1) and kept of docs; texts are not carried on."""
    broadcast = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = broadcast.value
        for b in batches:
            if not b.num_rows:
                continue
            stats, failed, score, kept = _verdicts(raw(b.column("text")), trees, limit)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(stats[:, k]) for k in range(len(STATS))], pa.array(failed), pa.array(score), pa.array(kept)],
                names=["doc_id", *STATS, "base_failed", "anomaly", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_STAT_SCHEMA}, base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the five statistics, base_failed, anomaly, kept.

    A null or empty text has no words and so fails. Equal rows get equal verdicts, each its own row. Empty tables give
    empty results; further columns of either table are ignored. Very long texts are counted whole.
    """
    return judge(docs, *fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules() keeps. One pass over the texts judges and filters."""
    forest, limit = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_verdicts(raw(b.column("text")), sent.value, limit)[3]))

    return docs.mapInArrow(run, docs.schema)
