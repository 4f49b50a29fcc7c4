"""Operators on a recording: one row for each sample, with an array of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    """The median of an array, null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def doubles(channels: str) -> Column:
    return F.transform(channels, lambda x: x.cast("double"))


def common_average(df: DataFrame, channels: str) -> DataFrame:
    """df with ``common`` (the sample's median over channels) and ``referenced`` (channels less it). Row by row, no shuffle."""
    v = doubles(channels)
    return df.withColumn("common", median(v)).withColumn("referenced", F.transform(v, lambda x: x - F.col("common")))


def block_median(df: DataFrame, channels: str, width: int = 32, stride: int = 16, least: int = 8) -> DataFrame:
    """df with ``block_median``: the median of the medians of overlapping channel blocks of at least ``least`` channels."""
    v = doubles(channels)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(channels) - 1), F.lit(stride)), lambda s: F.size(channels) - s >= least)
    return df.withColumn("block_median", median(F.transform(starts, lambda s: median(F.slice(v, s + 1, F.lit(width))))))


def derivative(df: DataFrame, sample: str, value: str) -> DataFrame:
    """df with ``step``: value less that of the sample before, 0 for the first. Samples are numbered, so it is an equi-join."""
    before = df.select((F.col(sample) + 1).alias(sample), F.col(value).alias("_before"))
    return df.join(before, sample, "left").withColumn("step", F.col(value) - F.coalesce("_before", value)).drop("_before")


def block_steps(df: DataFrame, sample: str, channels: str, block: int) -> DataFrame:
    """sample, block, y: by how much the median of each block of channels changes from the sample before, absolute; 0 for the first."""
    v = doubles(channels)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(channels) - 1), F.lit(block))
    own = df.select(F.col(sample), F.transform(starts, lambda s: median(F.slice(v, s + 1, F.lit(block)))).alias("_m"))
    before = own.select((F.col(sample) + 1).alias(sample), F.col("_m").alias("_before"))
    steps = F.zip_with("_m", F.coalesce("_before", "_m"), lambda a, b: F.abs(a - b))
    return own.join(before, sample, "left").select(sample, F.posexplode(steps).alias("block", "y"))


def decimate(df: DataFrame, sample: str, k: int, chunk: int) -> DataFrame:
    """Every k-th sample; counting starts anew in each chunk."""
    return df.where((F.col(sample) % chunk) % k == 0)


def bin_sum(df: DataFrame, sample: str, value: str, k: int) -> DataFrame:
    """bin, total of k consecutive samples; an incomplete bin drops out."""
    return df.groupBy(F.floor(F.col(sample) / k).cast("long").alias("bin")).agg(F.sum(value).alias("total"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def top_channels(df: DataFrame, channels: str, block: int, k: int) -> DataFrame:
    """block, rank, channel, power: each block's k channels of most power (sum of squares).

    Powers are summed map-side by channel; ranking sees a row for each channel.
    """
    each = df.select(F.posexplode(doubles(channels)).alias("channel", "v")).groupBy("channel").agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("power")).alias("neg"), "channel"))), 1, k)
    lists = each.groupBy(F.floor(F.col("channel") / block).cast("long").alias("block")).agg(best.alias("_b"))
    return lists.select("block", F.posexplode("_b").alias("_r", "_c")).select("block", (F.col("_r") + 1).alias("rank"), F.col("_c.channel").alias("channel"), (-F.col("_c.neg")).alias("power"))
