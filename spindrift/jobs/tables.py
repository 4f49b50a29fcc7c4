"""The stand-in tables seen as logs, spikes, traces and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.clock import micros

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: 2024-01-01 in microseconds: fits count from here, so that their sums keep their digits.
EPOCH = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, session, code, t, value, ts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event"), F.col("user_id").alias("session"), F.col("event_type").alias("code"), micros("ts").alias("t"), "value", "ts"
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, t0: the purchases."""
    return events(spark, sf_dir).where("code = 'purchase'").select(F.col("event").alias("trial"), F.col("t").alias("t0"))


def spikes(spark: SparkSession, sf_dir: str, unit: str = "code") -> DataFrame:
    """unit, t: all other events."""
    return events(spark, sf_dir).where("code <> 'purchase'").select(F.col(unit).alias("unit"), "t")


#: The same as SQL.
A = "a AS (SELECT event_id AS trial, epoch_us(ts) AS t0 FROM events WHERE event_type = 'purchase')"
S = "s AS (SELECT event_type AS unit, epoch_us(ts) AS t FROM events WHERE event_type <> 'purchase')"
SU = "s AS (SELECT user_id AS unit, epoch_us(ts) AS t FROM events WHERE event_type <> 'purchase')"
E_ = "e AS (SELECT event_id AS event, user_id AS session, event_type AS code, epoch_us(ts) AS t, value FROM events)"
