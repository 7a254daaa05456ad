"""Boosted trees from histograms of gradients, all folds at once, and importance by permutation.

Numbers are cut into at most 255 bins. A tree grows leaf by leaf, the best split first. One pass over the rows sums
gradients and curvatures by (model, leaf, feature, bin) for all leaves that might be split next; Spark adds the sums up,
and only these bounded tables reach the driver. The models of all folds grow side by side in the same passes, each from
the rows outside its fold, so a row's score under its own fold's model is a held-out one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.expressions import d
from statloom.functions.lineage import checkpointed
from statloom.operators.order import running_sums

SEED = 42
BINS = 255
#: Rounds after which scores are written anew, so that a pass evaluates no more trees than that.
KEPT_ROUNDS = 10


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    leaves: int = 15
    rate: float = 0.05
    ridge: float = 1.0
    least_rows: int = 20
    folds: int = 5


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Rows whose bin is at most cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        """Gives a leaf two leaves, numbered from the returned one on."""
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        for v in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)
        return first

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = left[node] + (bins[rows, feature[node]] > cut[node])
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(bins)]


@dataclass
class Sums:
    """Gradients, curvatures and counts of a leaf's rows by feature and bin, and its best split."""

    table: np.ndarray  # 3 x features x bins
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    values: tuple[float, float] = (0.0, 0.0)

    def find(self, s: Settings) -> Sums:
        left = np.cumsum(self.table, axis=2)[:, :, :-1]
        g, h, n = self.table[:, :1].sum(axis=2)[:, 0]
        (lg, lh, ln), (rg, rh, rn) = left, np.array([g, h, n])[:, None, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lg * lg / (lh + s.ridge) + rg * rg / (rh + s.ridge) - g * g / (h + s.ridge)
        gain = np.where((ln >= s.least_rows - 0.5) & (rn >= s.least_rows - 0.5), gain, -np.inf)
        best = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[best] > 1e-9:
            self.gain, self.feature, self.cut = float(gain[best]), int(best[0]), int(best[1])
            self.values = tuple(float(-s.rate * a[best] / (b[best] + s.ridge)) for a, b in ((lg, lh), (rg, rh)))
        return self


def edges_of(df: DataFrame, xs: list[str]) -> list[np.ndarray]:
    """Edges between the bins of each column: halfway between neighbouring near-quantiles."""
    shares = [k / BINS for k in range(BINS + 1)]
    got = df.agg(*[F.percentile_approx(d(F.col(c)), shares).alias(f"q{i}") for i, c in enumerate(xs)]).first()
    return [(lambda q: (q[1:] + q[:-1]) / 2)(np.unique(got[f"q{i}"] or [0.0]))[: BINS - 1] for i in range(len(xs))]


def folded(df: DataFrame, y: str, xs: list[str], cluster: str | None, folds: int) -> DataFrame:
    """y, the columns xs and fold of complete rows. Clusters stay whole where there are at least two a fold; else rows
    are dealt by a hash of their values."""
    rows = df.na.drop(subset=[y, *xs])
    whole = cluster is not None and rows.agg(F.approx_count_distinct(cluster, 0.01).alias("n")).first()["n"] >= 2 * folds
    key = [F.col(cluster)] if whole else [F.col(c) for c in [y, *xs]]
    return rows.select(d(F.col(y)).alias("y"), *[d(F.col(c)).alias(c) for c in xs], F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(folds)).cast("int").alias("fold"))


class Boosted:
    """The models of all folds."""

    def __init__(self, xs: list[str], edges: list[np.ndarray], binary: bool, start: np.ndarray, settings: Settings):
        self.xs, self.edges, self.binary, self.start, self.settings = xs, edges, binary, start, settings
        self.trees: list[list[Tree]] = []  # by round, then model

    def binned(self, rows: DataFrame) -> DataFrame:
        """y, fold, bins (a byte a feature) and raw (a score a model)."""
        xs, edges, start = self.xs, self.edges, self.start.tolist()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = np.stack([np.searchsorted(e, b.column(c).to_numpy(), "left") for c, e in zip(xs, edges, strict=True)], axis=1).astype(np.uint8)
                rows_of = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(xs)), len(bins), [None, pa.py_buffer(bins.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), rows_of.cast(pa.binary()), _lists(np.tile(start, (len(bins), 1)))], names=["y", "fold", "bins", "raw"])

        return rows.mapInArrow(cut, "y double, fold int, bins binary, raw array<double>")

    def gradients(self, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.binary:
            return raw - y[:, None], np.ones_like(raw)
        p = 1 / (1 + np.exp(-raw))
        return p - y[:, None], p * (1 - p)


def _bins(column: pa.Array) -> np.ndarray:
    """Rows of equally many bytes as a matrix."""
    values = column.cast(pa.binary())
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(values), -1)


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(raw: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32), raw.ravel())


def _leaf_sums(state: DataFrame, model: Boosted, since: int, growing: list[Tree], asked: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums of the asked leaves of the growing trees, by (model, leaf); trees from round `since` on aren't in raw yet."""
    recent, features = model.trees[since:], len(model.xs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, len(leaves), features, 256)) for leaves in asked]
        for b in batches:
            if not b.num_rows:
                continue
            bins, raw = _bins(b.column("bins")), _raw(b.column("raw"))
            raw = raw + sum((np.stack([t.score(bins) for t in trees], axis=1) for trees in recent), np.zeros_like(raw))
            g, h = model.gradients(b.column("y").to_numpy(), raw)
            fold = b.column("fold").to_numpy()
            for m, leaves in enumerate(asked):
                if not leaves:
                    continue
                place = np.full(len(growing[m].feature), -1)
                place[leaves] = np.arange(len(leaves))
                at = place[growing[m].leaf(bins)]
                own = np.flatnonzero((at >= 0) & (fold != m))
                for f in range(features):
                    code, size = at[own] * 256 + bins[own, f], len(leaves) * 256
                    for k, w in enumerate((g[own, m], h[own, m], None)):
                        total[m][k, :, f, :] += np.bincount(code, w, size).reshape(-1, 256)
        out = []
        for m, t in enumerate(total):
            leaf, f, b_ = np.nonzero(t[2])
            codes = [np.full(len(leaf), m), leaf, f, b_]
            out.append(pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in codes], *[pa.array(x[leaf, f, b_]) for x in t]], names=["m", "leaf", "f", "b", "g", "h", "n"]))
        yield from out

    told = state.mapInArrow(run, "m int, leaf int, f int, b int, g double, h double, n double").groupBy("m", "leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
    out = {(m, leaf): np.zeros((3, features, 256)) for m, leaves in enumerate(asked) for leaf in leaves}
    for (m, leaf), rows in told.groupby(["m", "leaf"]):
        out[m, asked[m][leaf]][:, rows["f"], rows["b"]] = rows[["g", "h", "n"]].to_numpy().T
    return out


def _grow(state: DataFrame, model: Boosted, since: int) -> list[Tree]:
    """One round: a tree for each model.

    Splitting a leaf for good needs the sums of its parts, which need a pass. Each pass therefore splits all leaves that
    are known, on trial, and asks for the sums of the smaller parts (the larger ones follow by subtraction); then the
    splits that come first in order of gain are taken, as far as all is known.
    """
    s, models = model.settings, len(model.start)
    trial = [Tree() for _ in range(models)]  # with every split that was tried
    known = {k: Sums(v).find(s) for k, v in _leaf_sums(state, model, since, trial, [[0]] * models).items()}
    while True:
        taken = [_best_first(trial[m], {n: v for (k, n), v in known.items() if k == m}, s) for m in range(models)]
        if all(done for done, _ in taken):
            return [tree for _, tree in taken]
        asked, pairs = [], []
        for m in range(models):
            parts = []
            for node in [n for k, n in known if k == m and trial[m].feature[n] < 0 and known[m, n].feature >= 0 and not taken[m][0]]:
                x = known[m, node]
                first = trial[m].split(node, x.feature, x.cut, x.values)
                low = x.table[2, x.feature, : x.cut + 1].sum() * 2 > x.table[2, x.feature].sum()
                parts.append(first + int(low))
                pairs.append((m, node, first + int(low), first + int(not low)))
            asked.append(parts)
        got = _leaf_sums(state, model, since, trial, asked)
        for m, node, small, large in pairs:
            known[m, small] = Sums(got[m, small]).find(s)
            known[m, large] = Sums(known[m, node].table - got[m, small]).find(s)


def _best_first(trial: Tree, known: dict[int, Sums], s: Settings) -> tuple[bool, Tree]:
    """The tree of the best splits in order of gain, and whether all that it needs is known."""
    tree, open_ = Tree(), [(0, 0)]  # (node of trial, node of tree)
    for _ in range(s.leaves - 1):
        if any(a not in known for a, _ in open_):
            return False, tree
        a, b = max(open_, key=lambda x: (known[x[0]].gain, -x[0]))
        if known[a].feature < 0:
            return True, tree
        if trial.feature[a] < 0:
            return False, tree
        first = tree.split(b, known[a].feature, known[a].cut, known[a].values)
        open_.remove((a, b))
        open_ += [(trial.left[a], first), (trial.left[a] + 1, first + 1)]
    return True, tree


def _advanced(state: DataFrame, model: Boosted, since: int) -> DataFrame:
    """state with the trees from round `since` on in raw."""
    recent = model.trees[since:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, raw = _bins(b.column("bins")), _raw(b.column("raw"))
                for trees in recent:
                    raw = raw + np.stack([t.score(bins) for t in trees], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), b.column("bins"), _lists(raw)], names=["y", "fold", "bins", "raw"])

    return checkpointed(state.mapInArrow(run, "y double, fold int, bins binary, raw array<double>")).persist()


def boost(rows: DataFrame, xs: list[str], binary: bool, settings: Settings = Settings()) -> tuple[Boosted, DataFrame]:
    """The models of folds 0, 1, ... over (y, xs, fold), and the rows (y, fold, bins, raw) with all scores in raw."""
    sums = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # a row a fold
    n, total = sum(v[0] for v in sums.values()), sum(v[1] for v in sums.values())
    means = np.array([(total - sums.get(m, (0, 0.0))[1]) / max(1, n - sums.get(m, (0, 0.0))[0]) for m in range(settings.folds)])
    share = np.clip(means, 1e-12, 1 - 1e-12)
    model = Boosted(xs, edges_of(rows, xs), binary, np.log(share / (1 - share)) if binary else means, settings)
    state, since = checkpointed(model.binned(rows)).persist(), 0
    for done in range(1, settings.rounds + 1):
        model.trees.append(_grow(state, model, since))
        if done - since == KEPT_ROUNDS or done == settings.rounds:
            before, state = state, _advanced(state, model, since)
            state.count()
            before.unpersist()
            since = done
    return model, state


def permuted(index: Column, size: Column, key: Column, rounds: int = 12) -> Column:
    """A pseudorandom permutation of 0 .. size-1 for each key: in every round, places that mirror each other at a random
    point swap or not, by a random bit of the pair."""

    def one(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(r, key) - x, size)
        return F.when(F.xxhash64(r, key, F.least(x, mirror)) % 2 == 0, x).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, one)


def with_partners(state: DataFrame) -> DataFrame:
    """state with the bins of another row of its fold, each row's being the partner of one: rows are numbered within
    their fold and join at the permuted number."""
    told = checkpointed(state.select("y", "fold", "bins", F.col("raw")[F.col("fold")].alias("raw"), F.monotonically_increasing_id().alias("id"), F.lit(1).alias("one")))
    placed = running_sums(told, "id", {"one": "place"}, ["fold"])
    sizes = told.groupBy("fold").agg(F.count("*").alias("size"))
    rows = placed.join(F.broadcast(sizes), "fold")  # a row a fold
    rows = rows.withColumn("to", permuted(F.col("place"), F.col("size"), F.col("fold").cast("long") + SEED))
    partners = placed.select("fold", F.col("place").alias("to"), F.col("bins").alias("partner"))
    return rows.join(partners, ["fold", "to"]).select("y", "fold", "bins", "raw", "partner")


def scores(state: DataFrame, model: Boosted, groups: dict[str, list[str]]) -> DataFrame:
    """fold, variable (null: none), y, score: held-out scores with each variable's columns taken from the partner."""
    columns = {v: [model.xs.index(c) for c in cs] for v, cs in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(b: pa.RecordBatch, variable: str | None, score: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column("fold"), pa.array([variable], pa.string()).take(pa.array(np.zeros(b.num_rows, np.int32))), b.column("y"), score], names=["fold", "variable", "y", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            fold = b.column("fold").to_numpy()
            bins, other = _bins(b.column("bins")), _bins(b.column("partner"))
            yield told(b, None, b.column("raw"))
            for v, places in columns.items():
                mixed = bins.copy()
                mixed[:, places] = other[:, places]
                score = model.start[fold].astype(float)
                for m in np.unique(fold):
                    own = np.flatnonzero(fold == m)
                    for trees in model.trees:
                        score[own] += trees[m].score(mixed[own])
                yield told(b, v, pa.array(score))

    return with_partners(state).mapInArrow(run, "fold int, variable string, y double, score double")


def quality(scored: DataFrame, by: list[str], binary: bool) -> DataFrame:
    """by and measure: AUC or R squared of score against y."""
    if not binary:
        away = (F.col("y") - F.col("score")) * (F.col("y") - F.col("score"))
        return scored.groupBy(*by).agg((1.0 - F.sum(away) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("measure"))
    filled = scored.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by})
    counts = filled.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1.0 - F.col("y")).alias("neg"))
    run = running_sums(counts, "score", {"neg": "below"}, by)
    auc = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return run.groupBy(*by).agg(auc.alias("measure"))


def _permuted_measures(rows: DataFrame, xs: list[str], binary: bool, groups: dict[str, list[str]] | None, settings: Settings) -> DataFrame:
    """fold, variable (null: none) and measure of held-out scores of boosted trees over folded() rows."""
    model, state = boost(rows, xs, binary, settings)
    told = checkpointed(scores(state, model, groups or {c: [c] for c in xs}))
    per = quality(told, ["fold", "variable"], binary).withColumn("fold", F.col("fold").cast("int")).withColumn("variable", F.nullif(F.coalesce("variable", F.lit("")), F.lit("")))
    per = checkpointed(per)
    state.unpersist()
    return per


def _losses(per: DataFrame) -> DataFrame:
    """variable, importance: what a variable's permutation takes from the measure, on average over the folds."""
    base = per.where("variable IS NULL").select("fold", F.col("measure").alias("base"))
    return per.where("variable IS NOT NULL").join(F.broadcast(base), "fold").groupBy("variable").agg(F.avg(F.col("base") - F.col("measure")).alias("importance"))


def importance(df: DataFrame, y: str, xs: list[str], binary: bool, cluster: str | None = None, groups: dict[str, list[str]] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The importance of cross_validated(), without fitting the usual model, which has no part in it."""
    rows = checkpointed(folded(df, y, xs, cluster, settings.folds)).persist()
    found = _losses(_permuted_measures(rows, xs, binary, groups, settings))
    rows.unpersist()
    return found


def cross_validated(df: DataFrame, y: str, xs: list[str], binary: bool, cluster: str | None = None, groups: dict[str, list[str]] | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(fold, model, measure) and (variable, importance).

    The usual model and boosted trees by AUC or R squared on held-out folds; a variable's importance is how much the
    trees lose, on average over the folds, when its columns (groups; one each by default) come from another row.
    """
    from statloom.operators.regression import fit_kind, predictions

    rows = checkpointed(folded(df, y, xs, cluster, settings.folds)).persist()
    per = _permuted_measures(rows, xs, binary, groups, settings)
    base = per.where("variable IS NULL").select("fold", F.col("measure").alias("base"))
    usual = None
    for k in range(settings.folds):
        fit = fit_kind(rows.where(F.col("fold") != k), "y", xs, "logistic" if binary else "linear")
        one = predictions(rows.where(F.col("fold") == k), "y", xs, fit).select(F.lit(k).alias("fold"), "y", F.col("fitted").alias("score"))
        usual = one if usual is None else usual.unionByName(one)
    plain = quality(usual, ["fold"], binary).select(F.col("fold").cast("int").alias("fold"), F.lit("usual").alias("model"), "measure")
    measures = checkpointed(plain.unionByName(base.select("fold", F.lit("boosted").alias("model"), F.col("base").alias("measure"))))
    rows.unpersist()
    return measures, _losses(per)
