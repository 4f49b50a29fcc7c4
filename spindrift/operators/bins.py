"""Occupied time bins of features: dilation, intersections, combinations and their yield."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranges import range_pairs


def dilated(df: DataFrame, feature: str, t: str, width: int, by: int, least: int, most: int) -> DataFrame:
    """feature, bin (distinct): each row's bin and ``by`` bins to either side, clipped to [least, most]."""
    place = F.floor(F.col(t) / width).cast("long")
    near = F.explode(F.sequence(place - by, place + by))
    return df.select(feature, near.alias("bin")).select(feature, F.greatest(F.lit(least), F.least(F.lit(most), "bin")).alias("bin")).distinct()


def combinations(bins: DataFrame, feature: str, k: int) -> DataFrame:
    """f1..fk (in order), bin: the bins that all k features occupy.

    Each bin's features come together once, as a sorted set of at most the
    number of features; combinations are read off the set.
    """
    sets = bins.groupBy("bin").agg(F.array_sort(F.collect_set(feature)).alias("_f")).where(F.size("_f") >= k)
    now = sets.select("bin", "_f", F.posexplode("_f").alias("_i", "f1"))
    for n in range(2, k + 1):
        rest = F.slice("_f", F.col("_i") + 2, F.size("_f"))
        now = now.select("bin", "_f", *[f"f{i}" for i in range(1, n)], "_i", F.posexplode(rest).alias("_j", f"f{n}"))
        now = now.withColumn("_i", F.col("_i") + F.col("_j") + 1).drop("_j")
    return now.select(*[f"f{i}" for i in range(1, k + 1)], "bin")


def yields(rewards: DataFrame, detections: DataFrame, by: str, window: int) -> DataFrame:
    """by, n, hit_rate, false_rate, yield: detections (by, t) against rewards (trial, t0), nearer than window.

    Hits are counted over all rewards, false ones over a group's detections.
    """
    near = range_pairs(rewards, detections, "t0", "t", window - 1, window - 1, closed=True)
    near = near.select("trial", by, "event").distinct()
    hit = near.groupBy(by).agg(F.countDistinct("trial").alias("_hit"), F.countDistinct("event").alias("_true"))
    total = rewards.agg(F.count("*")).scalar()
    every = detections.groupBy(by).agg(F.count("*").alias("n"))
    h = F.coalesce("_hit", F.lit(0)) / total
    far = 1 - F.coalesce("_true", F.lit(0)) / F.col("n")
    return every.join(hit, by, "left").select(by, "n", h.alias("hit_rate"), far.alias("false_rate"), (h * (1 - far)).alias("yield"))

