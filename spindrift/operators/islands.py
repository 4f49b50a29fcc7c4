"""Edges, runs and gaps along ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranges import previous

DAY = 86_400_000_000


def with_previous(df: DataFrame, keys: tuple[str, ...], t: str, row: str, take: tuple[str, ...], bucket: int = 7 * DAY) -> DataFrame:
    """df with the values of the row before, in order of (t, row)."""
    return previous(df, keys, (t, row), take, F.floor(F.col(t) / bucket))


def edges(df: DataFrame, keys: tuple[str, ...], t: str, row: str, state: str) -> DataFrame:
    """Rows whose state differs from the row before; the first row is none."""
    return with_previous(df, keys, t, row, (state,)).where(F.col(f"prev_{state}") != F.col(state)).drop(f"prev_{state}")


def rising(df: DataFrame, keys: tuple[str, ...], t: str, row: str, value: str, threshold: float) -> DataFrame:
    """Rows above the threshold whose row before wasn't."""
    now = with_previous(df, keys, t, row, (value,))
    return now.where((F.col(value) > threshold) & (F.col(f"prev_{value}") <= threshold)).drop(f"prev_{value}")


def debounced(df: DataFrame, keys: tuple[str, ...], t: str, row: str, gap: int) -> DataFrame:
    """Rows more than gap after the row before (kept or not); the first row stays."""
    now = with_previous(df, keys, t, row, (t,))
    return now.where(F.col(f"prev_{t}").isNull() | (F.col(t) - F.col(f"prev_{t}") > gap)).drop(f"prev_{t}")


def islands(df: DataFrame, keys: tuple[str, ...], ts: Column, gap: int, *measures: Column) -> DataFrame:
    """keys, started, and the measures of each run of rows at most gap (1 or more) microseconds apart: Spark's session windows, merged map-side.

    A session takes a row that comes just when it ends, so its gap is the largest distance within a run.
    """
    whole = F.session_window(ts, F.lit(f"{gap} microseconds"))
    return df.groupBy(*keys, whole.alias("_w")).agg(*measures).withColumn("started", F.col("_w.start")).drop("_w")


def largest_gap(df: DataFrame, t: str, row: str) -> DataFrame:
    """One row: gap, started, ended of the longest time between consecutive rows, the first of equals."""
    now = with_previous(df, (), t, row, (t,)).where(F.col(f"prev_{t}").isNotNull())
    best = F.max(F.struct((F.col(t) - F.col(f"prev_{t}")).alias("gap"), (-F.col(f"prev_{t}")).alias("neg")))
    return now.agg(best.alias("_g")).select(F.col("_g.gap").alias("gap"), (-F.col("_g.neg")).alias("started"), (F.col("_g.gap") - F.col("_g.neg")).alias("ended"))
