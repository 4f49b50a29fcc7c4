"""Event alignment on streams: sessions of bursts, and peri-event counts of late and early rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, started, ended, n of runs of rows less than gap apart, once the watermark has passed them."""
    grouped = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def live_pairs(trials: DataFrame, spikes: DataFrame, before: int, after: int, late: str) -> DataFrame:
    """trial, t0, unit, t of a stream of trials (trial, t0) joined to one of spikes (unit, t) in [t0 - before, t0 + after), in seconds.

    Both sides carry watermarks and the range bounds them, so state is dropped
    in time. Streams join on equal keys: here time slots as wide as the range,
    of which a trial touches two at most.
    """
    width = before + after
    slot = lambda c: F.floor(F.unix_micros(c) / (width * 1_000_000))
    low, high = F.col("t0") - F.make_dt_interval(secs=F.lit(before)), F.col("t0") + F.make_dt_interval(secs=F.lit(after))
    a = trials.withWatermark("t0", late).withColumn("slot", F.explode(F.sequence(slot(low), slot(high))))
    b = spikes.withWatermark("t", late).withColumn("slot_t", slot(F.col("t")))
    inside = (F.col("t") >= F.col("t0") - F.expr(f"INTERVAL {before} SECONDS")) & (F.col("t") < F.col("t0") + F.expr(f"INTERVAL {after} SECONDS"))
    return a.join(b, (F.col("slot") == F.col("slot_t")) & inside).select("trial", "t0", "unit", "t")
