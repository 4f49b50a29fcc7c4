"""Two clocks with an unknown offset, joined by the pattern of the times between their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import staged
from spindrift.operators import fit, ranges
from spindrift.operators.islands import with_previous


def intervals(df: DataFrame, keys: tuple[str, ...], t: str) -> DataFrame:
    """keys, t, gap: the time since the event before, by keys; the first event of a key has none and drops out."""
    now = with_previous(df.select(*keys, t), keys, t, t, (t,))
    return now.where(F.col(f"prev_{t}").isNotNull()).select(*keys, t, (F.col(t) - F.col(f"prev_{t}")).alias("gap"))


def offset_votes(rewards: DataFrame, pulses: DataFrame, keys: tuple[str, ...], t0: str, t: str, near: int, widest: int, bin_width: int) -> DataFrame:
    """keys, bin, votes, offset (mean): how many pairs of equal intervals, one on each clock, ask for an offset (pulse less reward).

    Intervals count as equal within ``near``; they are quantised to it, so
    that the join is by key, interval and time. Offsets go up to ``widest``,
    which bounds a reward's pairs by the pulses in that stretch of time also
    where all intervals are alike. An event that one clock lacks costs the
    two intervals beside it; the others still vote.
    """
    a = intervals(rewards, keys, t0).select(*keys, F.col(t0).alias("_t0"), F.col("gap").alias("_gap0"))
    a = a.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_gap0") - near) / near), F.floor((F.col("_gap0") + near) / near))))
    b = intervals(pulses, keys, t).select(*keys, F.col(t).alias("_t"), F.col("gap").alias("_gap"), F.floor(F.col("gap") / near).alias("_cell"))
    pairs = ranges.range_pairs(a, b, "_t0", "_t", widest, widest, (*keys, "_cell"), closed=True).where(F.abs(F.col("_gap") - F.col("_gap0")) <= near)
    offset = F.col("_t") - F.col("_t0")
    return pairs.groupBy(*keys, F.floor(offset / bin_width).cast("long").alias("bin")).agg(F.count("*").alias("votes"), F.sum(offset).alias("_sum"))


def best_offset(votes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, offset, votes: the mean offset of the two neighbouring bins that have most votes together, so that a bin's border splits none.

    Of equal sums the pair nearest to no offset wins, then the lower one.
    """
    two = votes.select(*keys, F.explode(F.array(F.col("bin") - 1, F.col("bin"))).alias("bin"), "votes", "_sum")
    two = two.groupBy(*keys, "bin").agg(F.sum("votes").alias("votes"), F.sum("_sum").alias("_sum"))
    rank = F.struct("votes", (-F.abs(F.col("bin"))).alias("near"), (-F.col("bin")).alias("low"), "_sum")
    best = two.groupBy(*keys).agg(F.max(rank).alias("_b"))
    return best.select(*keys, F.round(F.col("_b._sum") / F.col("_b.votes")).cast("long").alias("offset"), F.col("_b.votes").alias("votes"))


def aligned(
    rewards: DataFrame, pulses: DataFrame, keys: tuple[str, ...], trial: str, t0: str, t: str, near: int, widest: int, bin_width: int, tolerance: int, least: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(keys, trial, t0, predicted, matched) of every reward, and (keys, votes, n, slope, intercept, rmse) of every key's line.

    The offset that most intervals ask for places the rewards among the
    pulses; each then takes its nearest pulse closer than ``tolerance`` that no
    earlier one took, and a line by least squares through these pairs gives
    every reward's time on the pulses' clock. Keys with fewer than ``least``
    pairs have no line, and their rewards no prediction. The line is that of
    the seconds by which the pulse comes later, so that it keeps its digits.
    """
    offset = best_offset(offset_votes(rewards, pulses, keys, t0, t, near, widest, bin_width), keys)
    placed = rewards.join(offset, list(keys)).withColumn("_at", F.col(t0) + F.col("offset"))
    pairs = ranges.greedy_one_to_one(placed.select(*keys, trial, "_at"), pulses.select(*keys, F.col(t).alias("_p")), trial, "_at", "_p", tolerance, keys)
    pairs = staged(pairs.join(rewards.select(*keys, trial, t0), [*keys, trial]).select(*keys, trial, t0, F.col("_p").alias(t)), "pairs")
    first = pairs.groupBy(*keys).agg(F.min(t0).alias("_from"))
    xy = pairs.join(first, list(keys)).select(F.struct(*keys).alias("_k"), ((F.col(t0) - F.col("_from")) / 1e6).alias("x"), ((F.col(t) - F.col(t0)) / 1e6).alias("y"))
    line = fit.ols(xy, "_k", "x", "y").where(F.col("n") >= least).select("_k.*", "n", "slope", "intercept", "rmse")
    lines = line.join(offset, list(keys)).join(first, list(keys))
    shift = F.col("intercept") + F.col("slope") * (F.col(t0) - F.col("_from")) / 1e6
    everyone = rewards.join(lines, list(keys), "left").join(pairs.select(*keys, trial, F.col(t).alias("matched")), [*keys, trial], "left")
    predicted = (F.col(t0) + F.round(shift * 1e6)).cast("long")
    return everyone.select(*keys, trial, t0, predicted.alias("predicted"), "matched"), lines.select(*keys, "votes", "n", "slope", "intercept", "rmse")
