"""Ranks and running sums over the whole table without gathering it in one task.

Values are first reduced to distinct ones with counts; these are split at approximate quantiles into ranges, the
ranges' totals are summed up, and the windows run within one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of a global order holds, about. There are at least as many ranges as shuffle partitions.
RANGE_ROWS = 500_000
#: Cuts of an order that one nested comparison tells apart; more are told in two steps.
STEP = 64


def cuts_of(df: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> list[float]:
    """Approximate quantiles at which rows are split into ranges of the order, so many that a range stays near range_rows
    rows however many there are. A table that needs more ranges than shuffle partitions is read twice."""

    def found(ranges: int) -> tuple[int, list[float]]:
        shares = [k / ranges for k in range(1, ranges)] or [0.5]
        one = df.agg(F.count(order).alias("n"), F.percentile_approx(F.col(order).cast("double"), shares, 2 * ranges).alias("cuts")).first()
        return one["n"], sorted({c for c in one["cuts"] or [] if c == c}) if ranges > 1 else []

    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n, cuts = found(ranges)
    return found(-(-n // range_rows))[1] if n > ranges * range_rows else cuts


def cut_place(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below x: by halving, as nested comparisons; of more than STEP cuts every STEP-th is
    told so, and those between two of them are counted."""
    if len(cuts) > STEP:
        coarse = cut_place(x, cuts[STEP - 1 :: STEP])
        between_two = F.slice(F.lit([float(c) for c in cuts]), coarse * STEP + 1, F.lit(STEP))
        return coarse * STEP + F.size(F.filter(between_two, lambda c: x > c))

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x > F.lit(float(cuts[mid])), between(mid + 1, high)).otherwise(between(low, mid))

    return between(0, len(cuts))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], within: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Adds, for each column c of sums, the sum of c over rows of the group with a smaller `order` as sums[c].

    df has one row per group and order value; order is numeric and not null. Cuts of the order, from cuts_of(), spare
    finding them again; whatever they are, the sums are the same.
    """
    within = within or []
    split = df.withColumn("_range", cut_place(F.col(order), cuts_of(df, order) if cuts is None else cuts))
    totals = split.groupBy(*within, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*within, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = split.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums])
    joined = rows.join(starts, [*within, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_s_{c}") + F.col(f"_i_{c}")).alias(out) for c, out in sums.items()])


def quantiles(df: DataFrame, value: str, shares: list[float], within: list[str] | None = None) -> DataFrame:
    """One row per group: n, and q, the exact quantiles of value with linear interpolation between neighbours.

    Values are reduced to distinct ones with counts and running sums; a quantile is picked from the rows that hold its
    two neighbours, so no task holds a column's values.
    """
    within = within or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("ties"))
    run = running_sums(counted, "value", {"ties": "_before"}, within)
    totals = counted.groupBy(*within).agg(F.sum("ties").alias("n"))
    rows = run.join(totals, within) if within else run.crossJoin(F.broadcast(totals))  # one row without groups
    last = F.col("_before") + F.col("ties")

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_before")) & (place < last), F.col("value")))

    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ends = [x for k, h in enumerate(place) for x in (at(F.floor(h)).alias(f"_l{k}"), at(F.ceil(h)).alias(f"_h{k}"))]
    found = rows.groupBy(*within, "n").agg(*ends)
    pick = lambda k, h: F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * (h - F.floor(h))
    return found.select(*within, "n", F.array(*[pick(k, h) for k, h in enumerate(place)]).alias("q"))


def value_ranks(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """One row per group and distinct value: its count `ties` and the average rank `rank_avg` of its rows."""
    within = within or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("ties"))
    run = running_sums(counted, "value", {"ties": "_before"}, within)
    return run.select(*within, "value", "ties", (F.col("_before").cast("double") + (F.col("ties") + 1) / F.lit(2.0)).alias("rank_avg"))


def add_ranks(df: DataFrame, value: str, out: str = "rank_avg", within: list[str] | None = None) -> DataFrame:
    """df with the average rank of `value` among the group's rows; rows without a value are left out."""
    within = within or []
    ranks = value_ranks(df, value, within).select(*within, F.col("value").alias("_value"), F.col("rank_avg").alias(out))
    keyed = df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    return keyed.join(ranks, [*within, "_value"]).drop("_value")


def tie_sum() -> Column:
    """Sum of t^3 - t over the distinct values, as an aggregate over value_ranks()."""
    t = F.col("ties").cast("double")
    return F.sum(t * t * t - t)


def adjust_p(tests: DataFrame, p: str = "p", key: str = "variable") -> DataFrame:
    """tests with p_bh (Benjamini-Hochberg) and p_holm; null and NaN p values do not count. One row per test."""
    valid = F.when(F.isnan(p), F.lit(None)).otherwise(F.col(p).cast("double"))
    rows = tests.withColumn("_p", valid)
    m = F.count("_p").over(Window.partitionBy()).cast("double")
    up = Window.orderBy(F.col("_p").asc_nulls_last(), key)
    rows = rows.withColumn("_m", m).withColumn("_i", F.row_number().over(up).cast("double"))
    bh = F.min(F.col("_p") * F.col("_m") / F.col("_i")).over(up.rowsBetween(0, Window.unboundedFollowing))
    holm = F.max((F.col("_m") - F.col("_i") + 1.0) * F.col("_p")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    only = lambda c: F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), c))
    return rows.select(*tests.columns, only(bh).alias("p_bh"), only(holm).alias("p_holm"))
