"""Row filters that look beyond their row: fallback codes, session starts, feature names, finite values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_code_present(df: DataFrame, keys: tuple[str, ...], code: str, codes: tuple) -> DataFrame:
    """The rows of the first of ``codes`` that occurs at all in their key; keys with none of them give no rows."""
    place = F.coalesce(*[F.when(F.col(code) == c, F.lit(i)) for i, c in enumerate(codes)])
    best = df.groupBy(*keys).agg(F.min(place).alias("_best"))
    return df.join(best, list(keys)).where(place == F.col("_best")).drop("_best")


def after_start(df: DataFrame, keys: tuple[str, ...], t: str, is_start: Column) -> DataFrame:
    """The rows later than their key's first start; a key without a start gives no rows."""
    starts = df.groupBy(*keys).agg(F.min(F.when(is_start, F.col(t))).alias("_start"))
    return df.join(starts, list(keys)).where(F.col(t) > F.col("_start")).drop("_start")


def named(df: DataFrame, feature: str, prefixes: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """The features whose name starts with one of the prefixes (all, if none is given), but for those named in ``without``."""
    if prefixes:
        df = df.where(F.col(feature).rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"))
    return df.where(~F.col(feature).isin(*without)) if without else df


def finite(c: str | Column) -> Column:
    """Neither null, nor NaN, nor infinite."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def subtract_time(t: str, shift: Column | float | int) -> Column:
    """A time less a shift, one for all rows or one a row; a null shift counts as none."""
    return F.col(t) - (F.coalesce(shift, F.lit(0)) if isinstance(shift, Column) else F.lit(shift))


def time_axis(df: DataFrame, keys: tuple[str, ...], idx: str, start: str, end: str) -> DataFrame:
    """df with ``time``: row numbers (from 0) spread evenly over each key's length, least ``start`` to largest ``end``, for traces without times of their own."""
    own = df.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(end).alias("_z"), F.count("*").alias("_n"))
    time = F.col("_a") + F.col(idx) * ((F.col("_z") - F.col("_a")) / F.col("_n"))
    return df.join(own, list(keys)).withColumn("time", time).drop("_a", "_z", "_n")
