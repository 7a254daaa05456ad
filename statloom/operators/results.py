"""What is done with result tables: corrections, top lists, trends, unions, look-ups and small catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.expressions import d
from statloom.functions.text import fold

CORRECTIONS = {"bh": "p_bh", "holm": "p_holm", "none": "p"}
#: Rows that a group needs to be named as an extreme one.
LEAST_NAMED = 10


def corrected(tests: DataFrame, method: str) -> DataFrame:
    """tests with p_used, the p value after the chosen correction (bh, holm or none), instead of the two corrected ones."""
    return tests.withColumn("p_used", F.col(CORRECTIONS[method])).drop("p_bh", "p_holm")


def significant_counts(tests: DataFrame, alpha: float) -> DataFrame:
    """tests, before and after: how many p values and corrected ones (p, p_used) lie below alpha."""
    return tests.agg(F.count("p").alias("tests"), F.count_if(F.col("p") < alpha).alias("before"), F.count_if(F.col("p_used") < alpha).alias("after"))


def top_tests(tests: DataFrame, most: int = 3) -> DataFrame:
    """The tests with the smallest p, ties by variable; null p values are left out."""
    return tests.where("p is not null").orderBy("p", "variable").limit(most)


def strongest_levels(terms: DataFrame, most: int = 4) -> DataFrame:
    """variable, term, p: the level with the smallest p of each variable, of the `most` variables with the smallest."""
    best = terms.where("p is not null").groupBy("variable").agg(F.min(F.struct("p", "term")).alias("b"))
    return best.select("variable", F.col("b.term").alias("term"), F.col("b.p").alias("p")).orderBy("p", "variable").limit(most)


def cumulated(axes: DataFrame, order: str, share: str) -> DataFrame:
    """axes with the running sum of share. One row per axis of a model."""
    return axes.withColumn("cumulated", F.sum(share).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def trend(levels: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, steps, trend: rising or falling where every step between neighbouring levels is, else null. One row a level."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order))
    per = levels.withColumn("_step", step).groupBy(by).agg(F.count("_step").alias("steps"), F.bool_and(F.col("_step") > 0).alias("up"), F.bool_and(F.col("_step") < 0).alias("down"))
    return per.select(by, "steps", F.when(F.col("up"), "rising").when(F.col("down"), "falling").alias("trend"))


def with_cluster_mean(df: DataFrame, cluster: str, value: str, out: str) -> DataFrame:
    """df with the mean of value over the row's cluster. The means are aggregated first, so no cluster is sorted whole."""
    means = df.groupBy(F.col(cluster).alias("_of")).agg(F.avg(d(F.col(value))).alias(out))
    return df.join(means, F.col(cluster).eqNullSafe(F.col("_of"))).drop("_of")


def leading_categories(frequencies: DataFrame, most: int = 2) -> DataFrame:
    """The categories of each variable with the largest share, with their rank; ties by name."""
    rank = F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("share"), "category"))
    return frequencies.withColumn("rank", rank).where(F.col("rank") <= most)


def extreme_groups(shares: DataFrame, least: int = LEAST_NAMED) -> DataFrame:
    """y, low_group, low, high_group, high: the groups x with the smallest and largest share of y, of those with rows enough.

    shares: x, y, row_total, share.
    """
    big = shares.where(F.col("row_total") >= least)
    return big.groupBy("y").agg(F.min(F.struct("share", "x")).alias("a"), F.max(F.struct("share", "x")).alias("b")).select("y", F.col("a.x").alias("low_group"), F.col("a.share").alias("low"), F.col("b.x").alias("high_group"), F.col("b.share").alias("high"))


def top_contributions(points: DataFrame, most: int = 4) -> DataFrame:
    """axis, category, side, contribution, rank: the `most` categories of each side of an axis that contribute more than
    the axis's mean. points: axis, category, coordinate, contribution."""
    means = points.groupBy("axis").agg(F.avg("contribution").alias("mean"))
    above = points.join(means, "axis").where(F.col("contribution") > F.col("mean")).withColumn("side", F.when(F.col("coordinate") < 0, "negative").otherwise("positive"))
    rank = F.row_number().over(Window.partitionBy("axis", "side").orderBy(F.desc("contribution"), "category"))
    return above.withColumn("rank", rank).where(F.col("rank") <= most).select("axis", "category", "side", "contribution", "rank")


def candidate_pairs(importance: DataFrame, top: int = 4, most: int = 6) -> DataFrame:
    """a, b: pairs of the `top` most important terms, at most `most` of them, the more important ones first."""
    best = importance.orderBy(F.desc("importance"), "term").limit(top)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "term")))
    a, b = best.alias("a"), best.alias("b")
    pairs = a.join(b, F.col("a.place") < F.col("b.place")).orderBy("a.place", "b.place").limit(most)  # a few terms
    return pairs.select(F.col("a.term").alias("a"), F.col("b.term").alias("b"))


def sorted_effects(effects: DataFrame) -> DataFrame:
    """effects (unit, estimate) with their place from the smallest estimate on."""
    return effects.withColumn("place", F.row_number().over(Window.orderBy("estimate", "unit")))


def bibliography(works: DataFrame, cited: DataFrame) -> DataFrame:
    """The works whose key is cited, with their place in an order that neither accents nor case change."""
    return works.join(cited.select("key").distinct(), "key", "left_semi").withColumn("place", F.row_number().over(Window.orderBy(fold(F.col("author")), "year", "key")))


def newest(rows: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """rows with their place among their owner's, the newest first; rows without a time come last.

    at is a date or a time. Places are counted within an owner's days, so that a busy owner is spread over tasks, and
    later days' rows are added: those are one row a day.
    """
    # a struct, as equal structs may hold nulls and equal columns may not
    days = rows.withColumn("_day", F.struct(F.col(owner).alias("owner"), F.to_date(at).alias("day")))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc(at), key))
    counts = days.groupBy("_day").agg(F.count("*").alias("_rows"))
    later = F.sum("_rows").over(Window.partitionBy("_day.owner").orderBy(F.desc("_day.day")).rowsBetween(Window.unboundedPreceding, -1))
    joined = days.withColumn("_inside", inside).join(counts.select("_day", F.coalesce(later, F.lit(0)).alias("_later")), "_day")
    return joined.select(*rows.columns, (F.col("_later") + F.col("_inside")).cast("int").alias("place"))


def union_facts(*sections: DataFrame) -> DataFrame:
    """The distinct rows of all sections."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out.distinct()


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and its first place in the order, once each."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows whose key the others don't have; null keys stay."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def unseen_categories(df: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    """category, n: categories in the data that the declared list (category) doesn't have."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    return found.join(declared.select("category"), "category", "left_anti")


def dangling(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """rows whose key no other row has."""
    return rows.join(others.select(F.col(other_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")


def present_categories(df: DataFrame, column: str, where: Column) -> DataFrame:
    """category: those of all rows that also occur where the condition holds."""
    every = df.select(F.col(column).alias("category")).distinct()
    return every.join(df.where(where).select(F.col(column).alias("category")).distinct(), "category", "left_semi")


def with_counts(users: DataFrame, key: str, items: DataFrame, item_key: str, out: str) -> DataFrame:
    """users with the number of their items, 0 without any."""
    per = items.groupBy(F.col(item_key).alias("_key")).agg(F.count("*").alias(out))
    return users.join(per, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(out, F.coalesce(out, F.lit(0)))


def session_user(sessions: DataFrame, users: DataFrame, now: Column, idle_seconds: int, absolute_seconds: int) -> DataFrame:
    """token and user of the sessions (token, user_id, created, seen, in seconds) that are still open at `now`."""
    live = sessions.where((now - F.col("seen") <= idle_seconds) & (now - F.col("created") <= absolute_seconds))
    return live.join(users, "user_id").select("token", "user_id", "name")


def admissions(runs: DataFrame, owner: str, status: str, per_owner: int) -> DataFrame:
    """owner, running, admitted: whether the owner may start another run."""
    return runs.groupBy(owner).agg(F.count_if(F.col(status) == "running").alias("running")).withColumn("admitted", F.col("running") < per_owner)


def recovered(runs: DataFrame, status: str) -> DataFrame:
    """runs as they are after a restart: what was running has failed."""
    return runs.withColumn(status, F.when(F.col(status) == "running", "error").otherwise(F.col(status)))


def term_labels(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """terms (variable, level) with a text: the variable's label and the level, or the names where none is known."""
    known = labels.select("variable", "label")
    return terms.join(known, "variable", "left").withColumn("text", F.concat_ws(": ", F.coalesce("label", "variable"), "level")).drop("label")


def catalogue(variables: DataFrame, roles: DataFrame, categories: DataFrame, most: int = 8) -> DataFrame:
    """variables with role (other where none is given) and their first categories, joined by commas."""
    rank = F.row_number().over(Window.partitionBy("variable").orderBy("category"))
    few = categories.withColumn("_at", rank).where(F.col("_at") <= most).groupBy("variable").agg(F.array_join(F.sort_array(F.collect_list("category")), ", ").alias("categories"))
    return variables.join(roles, "variable", "left").join(few, "variable", "left").withColumn("role", F.coalesce("role", F.lit("other")))


def json_answer(text: Column, schema: str) -> Column:
    """The first {...} of a text as a struct; null where it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def guarded(candidates: DataFrame, key: str, refused: DataFrame) -> DataFrame:
    """key, text, accepted: the first candidate (key, attempt, text, fallback) that isn't refused (key, attempt), else
    the fallback."""
    open_ones = candidates.join(refused.select(key, "attempt").distinct(), [key, "attempt"], "left_anti")
    first = open_ones.groupBy(key).agg(F.min(F.struct("attempt", "text")).alias("_first"))
    each = candidates.groupBy(key).agg(F.min("fallback").alias("fallback"))
    return each.join(first, key, "left").select(key, F.coalesce("_first.text", "fallback").alias("text"), F.col("_first").isNotNull().alias("accepted"))


def journal_by_action(journal: DataFrame) -> DataFrame:
    """action, variables: the privacy journal (variable, action) regrouped, names in order."""
    return journal.groupBy("action").agg(F.array_join(F.sort_array(F.collect_set("variable")), ", ").alias("variables"))
