"""How well each feature's detected peaks tell rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranges import range_pairs


def feature_audit(peaks: DataFrame, rewards: DataFrame, before: int, after: int) -> DataFrame:
    """feature, n_peaks, n_rewards, hit_rate, median_error, mean_error, false_rate, f1 of every feature that has a peak.

    peaks (feature, t), rewards (trial, t0). A reward is hit if a peak lies in
    its closed window [t0 - before, t0 + after]; its error is the absolute
    distance of the nearest one. A peak in no window is false. f1 weighs hit
    rate and the share of true peaks equally; without hits it is 0 and there
    is no error. One range join serves all of it.
    """
    own = peaks.select("feature", "t").distinct()
    pairs = range_pairs(rewards.select("trial", "t0"), own, "t0", "t", before, after, closed=True)
    off = F.abs(F.col("t") - F.col("t0"))
    each = pairs.groupBy("feature", "trial").agg(F.min(off).alias("off"))
    hits = each.groupBy("feature").agg(F.count("*").alias("_hits"), F.percentile("off", F.lit(0.5)).alias("median_error"), F.avg("off").alias("mean_error"))
    true = pairs.select("feature", "t").distinct().groupBy("feature").agg(F.count("*").alias("_true"))
    n_rewards = rewards.agg(F.count("*")).scalar()
    n = own.groupBy("feature").agg(F.count("*").alias("n_peaks"))
    j = n.join(hits, "feature", "left").join(true, "feature", "left")
    hit = F.coalesce(F.try_divide("_hits", n_rewards), F.lit(0.0))
    right = F.coalesce("_true", F.lit(0)) / F.col("n_peaks")
    f1 = F.coalesce(F.try_divide(2 * hit * right, hit + right), F.lit(0.0))
    return j.select("feature", "n_peaks", n_rewards.alias("n_rewards"), hit.alias("hit_rate"), "median_error", "mean_error", (1 - right).alias("false_rate"), f1.alias("f1"))


def window_peaks(traces: DataFrame, rewards: DataFrame, before: int, after: int, height: float) -> DataFrame:
    """feature, trial, t, y: the highest value of a feature in each reward's closed window, the first of equals, where it reaches ``height``."""
    pairs = range_pairs(rewards.select("trial", "t0"), traces.select("feature", "t", "y"), "t0", "t", before, after, closed=True)
    best = pairs.groupBy("feature", "trial").agg(F.max(F.struct("y", (-F.col("t")).alias("neg"))).alias("_b"))
    return best.where(F.col("_b.y") >= height).select("feature", "trial", (-F.col("_b.neg")).alias("t"), F.col("_b.y").alias("y"))
