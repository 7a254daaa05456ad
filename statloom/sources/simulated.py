"""A simulated clustered survey with known parameters, generated by Spark from hashed uniforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: True values: intercept and effects of the outcome, deviation between clusters, event rate.
TRUE = {"intercept": -0.6, "x": 0.7, "z": 0.5, "sigma": 0.8, "rate": 0.11}


def _uniform(seed: int, *keys):
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / F.lit(2.0**53)


def _normal(seed: int, *keys):
    return F.sqrt(-2.0 * F.log(_uniform(seed, *keys))) * F.cos(2.0 * F.pi() * _uniform(seed + 1, *keys))


def survey(spark: SparkSession, clusters: int = 120, per_cluster: int = 20, seed: int = 2026) -> DataFrame:
    """One row a person: cluster, a cluster variable z, x, a group, a binary outcome, a count, a time and its event."""
    n = clusters * per_cluster
    rows = spark.range(n).select(F.col("id"), (F.col("id") / per_cluster).cast("long").alias("cluster"))
    rows = rows.select("id", "cluster", _normal(seed + 10, "id").alias("x"), (_uniform(seed + 20, "cluster") < 0.4).cast("double").alias("z"), _normal(seed + 30, "cluster").alias("u"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.floor(_uniform(seed + 40, "id") * 3) + 1).cast("int")).alias("group"))
    eta = TRUE["intercept"] + TRUE["x"] * F.col("x") + TRUE["z"] * F.col("z") + TRUE["sigma"] * F.col("u")
    event_time = -F.log(_uniform(seed + 60, "id")) / (TRUE["rate"] * F.exp(0.5 * F.col("x")))
    censored = 5.0 + 15.0 * _uniform(seed + 70, "id")
    return rows.select(
        "id", "cluster", "group", "x", "z",
        (_uniform(seed + 50, "id") < 1.0 / (1.0 + F.exp(-eta))).cast("int").alias("outcome"),
        (2.0 + 1.5 * F.col("x") + 1.2 * F.col("u") + 2.6 * _normal(seed + 80, "id")).alias("score"),
        F.least(event_time, censored).alias("time"), (event_time <= censored).cast("int").alias("event"),
        F.when(_uniform(seed + 90, "id") < 0.03, F.lit(None)).otherwise(F.round(20 + 4 * _normal(seed + 100, "id"), 1)).alias("index"),
        (0.6 + _uniform(seed + 110, "id")).alias("weight"),
    )
