"""Clocks: whole microseconds, the five rules for zero, and linear or piecewise warps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranges import following, previous

MODES = ("zero_or_raw", "zero_or_first", "zero_or_min", "first", "min")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    c = c.cast("timestamp_ntz")
    seconds = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def zero_clock(df: DataFrame, mode: str, session: str, t: str, row: str, is_zero: Column) -> DataFrame:
    """df with ``t0``: t less the session's zero.

    The zero is the first (by row) time where is_zero holds; if there is none:
    0, the first time, or the least time. Modes "first" and "min" don't look
    for one. Zeros are aggregated by session and joined back, so a long
    session isn't gathered in one task.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    zero = F.min_by(F.when(is_zero, F.col(t)), F.when(is_zero, F.col(row)))
    first, least = F.min_by(t, row), F.min(t)
    chosen = {
        "zero_or_raw": F.coalesce(zero, F.lit(0)), "zero_or_first": F.coalesce(zero, first),
        "zero_or_min": F.coalesce(zero, least), "first": first, "min": least,
    }[mode]
    zeros = df.groupBy(session).agg(chosen.alias("_zero"))
    return df.join(zeros, session).withColumn("t0", F.col(t) - F.col("_zero")).drop("_zero")


def warp(t: Column, stretch: Column | float, offset: Column | float) -> Column:
    return t * stretch + offset


def unwarp(t: Column, stretch: Column | float, offset: Column | float) -> Column:
    """The inverse of ``warp``."""
    return (t - offset) / stretch


def unwarp_divided(t: Column, stretch: Column | float, offset: Column | float) -> Column:
    """The variant that divides first and then subtracts; not the inverse of ``warp`` unless stretch is 1."""
    return t / stretch - offset


def piecewise_warp(points: DataFrame, knots: DataFrame, key: str, t: str, x: str, y: str, width: int) -> DataFrame:
    """points with ``warped``: y interpolated between the knots (key, x, y) around t, end segments extended.

    Each key's knots make consecutive segments; a point takes the segment that
    holds it, the first or last one if it lies outside. Keys with fewer than two
    knots give null. Each knot gets the next one, and each point
    the last knot at or before it, by looking within buckets of ``width``.
    """
    k = knots.select(key, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    k = previous(k.withColumn("_neg", -F.col("_x")), (key,), ("_neg",), ("_x", "_y"), F.floor(F.col("_neg") / width))
    segment = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("prev__x").alias("x2"), F.col("prev__y").alias("y2"))
    segments = k.where("prev__x IS NOT NULL").select(key, (-F.col("_x")).alias("_at"), segment.alias("_s"))
    ends = segments.groupBy(key).agg(F.max_by("_s", "_at").alias("_first"))  # turned round, so the largest is the first segment
    own = points.withColumn("_neg", -F.col(t))
    inner = following(own, segments, (key,), "_neg", "_at", "_s", width).drop("_neg", "_at")
    before = own.join(ends, key).where(F.col(t) < F.col("_first.x")).withColumn("_s", F.col("_first")).drop("_neg", "_first")
    line = F.col("_s.y") + (F.col(t) - F.col("_s.x")) * (F.col("_s.y2") - F.col("_s.y")) / (F.col("_s.x2") - F.col("_s.x"))
    without = points.join(ends, key, "left_anti").withColumn("warped", F.lit(None).cast("double"))
    return inner.unionByName(before).withColumn("warped", line).drop("_s").unionByName(without)
