"""Peri-event histograms and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import blocks


def counts(trials: DataFrame, spikes: DataFrame, before: int, after: int, width: int) -> DataFrame:
    """unit, bin, n: spikes (unit, t) in [t0 - before, t0 + after) of trials (trial, t0), by bin of the offset."""
    return blocks.counts(trials, spikes, "unit", "t0", "t", before, after, width)


def rates(trials: DataFrame, spikes: DataFrame, before: int, after: int, width: int, per: float) -> DataFrame:
    """unit, bin, n, rate with empty bins filled; rate is n / (all trials x bin length in units of ``per``)."""
    found = counts(trials, spikes, before, after, width)
    bins = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((before + after) // width - 1).cast("long")))
    grid = spikes.select("unit").distinct().select("unit", bins.alias("bin"))
    total = trials.agg(F.count("*")).scalar()
    n = F.coalesce("n", F.lit(0))
    return grid.join(found, ["unit", "bin"], "left").select("unit", "bin", n.alias("n"), (n / (total * (width / per))).alias("rate"))


def centre(before: int, width: int) -> Column:
    """A bin's middle, as offset from the event."""
    return (F.col("bin") + 0.5) * width - before


def sharpness(rate: DataFrame, before: int, width: int, baseline_end: int) -> DataFrame:
    """unit, score (peak rate after baseline_end less mean rate before it), peak, baseline, latency (first best bin's middle)."""
    c = centre(before, width)
    late = c >= baseline_end
    peak = F.max(F.when(late, F.struct(F.col("rate"), -F.col("bin"), c.alias("latency"))))
    return rate.groupBy("unit").agg(F.avg(F.when(~late, F.col("rate"))).alias("baseline"), peak.alias("_p")).select(
        "unit", (F.col("_p.rate") - F.coalesce("baseline", F.lit(0.0))).alias("score"), F.col("_p.rate").alias("peak"), "baseline",
        F.col("_p.latency").alias("latency"),
    )


def reliability(trials: DataFrame, spikes: DataFrame, latencies: DataFrame, before: int, after: int, half: int) -> DataFrame:
    """unit, reliability: share of all trials with a spike within half (closed) of the unit's latency."""
    first, last = F.ceil(F.greatest(F.col("latency") - half, F.lit(-before))), F.floor(F.least(F.col("latency") + half, F.lit(after - 1)))
    aimed = spikes.join(latencies, "unit").where("latency IS NOT NULL").select("unit", "t", first.cast("long").alias("first"), last.cast("long").alias("last"))
    hits = blocks.hit_trials(trials, aimed, "unit", before, after, "first", "last")
    total = trials.agg(F.count("*")).scalar()
    return latencies.join(hits, "unit", "left").select("unit", (F.coalesce("hits", F.lit(0)) / total).alias("reliability"))


def floor_sd(sd: Column, mean: Column) -> Column:
    """The baseline's deviation, kept from being too small."""
    return F.when(sd < 0.1, F.greatest(F.lit(0.1), mean * 0.05 + 0.1)).otherwise(sd)


def baseline_z(rate: DataFrame, before: int, width: int, baseline_end: int, floor=floor_sd) -> DataFrame:
    """unit, bin, z: rates against the mean and (population) deviation, not under ``floor``, of the bins before baseline_end."""
    base = F.when(centre(before, width) < baseline_end, F.col("rate"))
    stats = rate.groupBy("unit").agg(F.avg(base).alias("mean"), F.stddev_pop(base).alias("sd"))
    return rate.join(stats, "unit").select("unit", "bin", ((F.col("rate") - F.col("mean")) / floor(F.col("sd"), F.col("mean"))).alias("z"))


def classify(z: DataFrame, before: int, width: int, pre: int, threshold: float) -> DataFrame:
    """unit, unit_class, peak_z, latency from bins' z: MOTOR, REWARD, SUPPRESSED or UNRESPONSIVE.

    pre: how far before the event the early peak may lie. A suppressed unit's
    latency is that of its largest later bin.
    """
    c = centre(before, width)
    best = lambda cond: F.max(F.when(cond, F.struct(F.col("z"), -F.col("bin"), c.alias("latency"))))
    a = z.groupBy("unit").agg(
        best(c >= 0).alias("post"), best((c >= -pre) & (c < 0)).alias("pre"), F.min(F.when(c >= 0, F.col("z"))).alias("trough")
    )
    post, early = F.coalesce("post.z", F.lit(0.0)), F.coalesce("pre.z", F.lit(0.0))
    motor, reward, less = (early >= threshold) & (early > post), post >= threshold, F.coalesce("trough", F.lit(0.0)) <= -threshold
    return a.select(
        "unit",
        F.when(motor, "MOTOR").when(reward, "REWARD").when(less, "SUPPRESSED").otherwise("UNRESPONSIVE").alias("unit_class"),
        F.when(motor, early).when(reward, post).when(less, F.col("trough")).otherwise(F.greatest(post, early)).alias("peak_z"),
        F.when(motor, F.col("pre.latency")).otherwise(F.col("post.latency")).alias("latency"),
    )
