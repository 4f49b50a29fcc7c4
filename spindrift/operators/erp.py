"""Event-related windows of indexed traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(trials: DataFrame, trace: DataFrame, keys: tuple[str, ...], pre: int, post: int) -> DataFrame:
    """keys, trial, code, rel, z: rows at idx0 - pre .. idx0 + post - 1 of the trace (keys, idx, z); incomplete windows drop out."""
    spread = trials.select(*keys, "trial", "code", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel"), "idx0")
    joined = spread.withColumn("idx", F.col("idx0") + F.col("rel")).join(trace, [*keys, "idx"])
    full = joined.groupBy("trial").agg(F.count("*").alias("_n")).where(F.col("_n") == pre + post).select("trial")
    return joined.join(full, "trial").select(*keys, "trial", "code", "rel", "z")


def placed(marks: DataFrame, trace: DataFrame, keys: tuple[str, ...], pre: int, post: int) -> DataFrame:
    """The marks (keys, trial, idx) whose rows idx - pre .. idx + post - 1 all exist, as idx0, with strict: the trace goes on after the window.

    Rows are numbered from 1; no window needs to be joined to find out.
    """
    length = trace.groupBy(*keys).agg(F.max("idx").alias("_n"))
    at = marks.withColumnRenamed("idx", "idx0").join(length, list(keys)).where((F.col("idx0") - pre >= 1) & (F.col("idx0") + post - 1 <= F.col("_n")))
    return at.withColumn("strict", F.col("idx0") + post - 1 < F.col("_n")).drop("_n")


def mean_sem(w: DataFrame) -> DataFrame:
    """code, rel, n, mean, sem (population deviation over root n)."""
    return w.groupBy("code", "rel").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), (F.stddev_pop("z") / F.sqrt(F.count("*"))).alias("sem"))


def score(w: DataFrame, least: int = 3) -> DataFrame:
    """code, score: mean absolute mean over mean deviation (plus 1e-9); 0 below ``least`` trials."""
    by = w.groupBy("code", "rel").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    ratio = F.avg(F.abs("m")) / (F.avg("s") + 1e-9)
    return by.groupBy("code").agg(F.when(F.max("n") >= least, ratio).otherwise(0.0).alias("score"))
