"""Figures' data and short reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.islands import DAY
from spindrift.operators.ranges import HELD_ROWS, with_halo


def running_median(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, half: int, bucket: int = 7 * DAY, held: int = HELD_ROWS) -> DataFrame:
    """df with ``running``: the median of the rows from half before to half - 1 after.

    Rows are numbered by buckets of the first column of the order and go by
    blocks with the rows that they look at, so no task needs a whole key.
    """
    rows = with_halo(df, keys, order, F.floor(F.col(order[0]) / bucket), half, half, held)
    w = Window.partitionBy(*keys, "_block").orderBy("_idx").rowsBetween(-half, half - 1)
    return rows.withColumn("running", F.percentile(value, F.lit(0.5)).over(w)).where("_own").drop("_block", "_idx", "_own")


def interpolated(df: DataFrame, keys: tuple[str, ...], idx: str, value: str, held: int = HELD_ROWS) -> DataFrame:
    """df with ``filled``: null values on the line between their filled neighbours, flat at the ends.

    Neighbours are sought among the ``held`` numbers around, and beyond them in a
    table with the first and last filled row of every such stretch.
    """
    rows = df.withColumn("_s", F.floor(F.col(idx) / held).cast("long"))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    ends = rows.groupBy(*keys, "_s").agg(F.min(point).alias("_low"), F.max(point).alias("_high"))
    along = Window.partitionBy(*keys).orderBy("_s")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*keys, "_s", F.last("_high", ignorenulls=True).over(back).alias("_before"), F.first("_low", ignorenulls=True).over(ahead).alias("_after"))
    w = Window.partitionBy(*keys, "_s").orderBy(idx)
    a = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumns({"_a": a, "_b": b}).join(ends, [*keys, "_s"]).withColumns({"_a": F.coalesce("_a", "_before"), "_b": F.coalesce("_b", "_after")})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(idx) - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = F.when(F.col("_a.i") < F.col("_b.i"), line).otherwise(F.coalesce("_a.v", "_b.v"))
    return near.withColumn("filled", filled).drop("_a", "_b", "_before", "_after", "_s")


def quality_band(rmse_ms: str):
    """Bands of a fit's error in milliseconds."""
    c = F.col(rmse_ms)
    return F.when(c < 5, "EXCELLENT").when(c < 20, "GOOD").when(c < 50, "OK").otherwise("POOR")
