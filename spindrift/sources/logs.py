"""Readers of logs, labels, sidecars and sync documents, all as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYNC_SCHEMA = (
    "warp struct<stretch: double, offset: double, rmse: double>, "
    "events array<struct<bhv_time: double, ephys_time: double>>, metadata map<string, string>"
)


def behaviour(spark: SparkSession, path: str) -> DataFrame:
    """path, row, ts, code of headerless two-column logs; rows that aren't numbers vanish, further columns are ignored."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), F.split("value", ",").alias("f"))
    number = lambda i: F.expr(f"try_cast(trim(get(f, {i})) AS double)")
    found = lines.select("path", "row", number(0).alias("ts"), number(1).alias("code"))
    return found.where("ts IS NOT NULL AND code IS NOT NULL AND NOT isnan(ts)").withColumn("code", F.col("code").cast("int"))


def meta(spark: SparkSession, path: str) -> DataFrame:
    """path, fields (a map) of key=value sidecars; a value may contain =."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "=", 2).alias("kv")).where("size(kv) = 2")
    entry = F.struct(F.trim(F.get("kv", F.lit(0))).alias("key"), F.trim(F.get("kv", F.lit(1))).alias("value"))
    return lines.groupBy("path").agg(F.map_from_entries(F.array_agg(entry)).alias("fields"))


def recording_shape(fields: str | Column) -> list[Column]:
    """n_channels, rate, n_samples, microvolts a bit; defaults where a key is missing."""
    f = F.col(fields) if isinstance(fields, str) else fields
    get = lambda k, d: F.coalesce(F.try_element_at(f, F.lit(k)).cast("double"), F.lit(float(d)))
    n = get("nSavedChans", 385)
    return [
        n.cast("int").alias("n_channels"), get("imSampRate", 30000).alias("rate"),
        F.floor(get("fileSizeBytes", 0) / (2 * n)).cast("long").alias("n_samples"),
        (get("imAiRangeMax", 0.6) * 1e6 / (get("imGain", 500) * 32768)).alias("microvolts"),
    ]


def unit_labels(spark: SparkSession, path: str) -> DataFrame:
    """unit, label of a tab-separated table with cluster_id and group or kslabel, whatever their case."""
    df = spark.read.csv(path, sep="\t", header=True)
    names = {c.strip().lower(): c for c in df.columns}
    label = names.get("group") or names.get("kslabel")
    if label is None or "cluster_id" not in names:
        raise ValueError("no cluster_id with group or kslabel")
    return df.select(F.expr(f"try_cast(`{names['cluster_id']}` AS int)").alias("unit"), F.lower(F.trim(F.col(f"`{label}`"))).alias("label"))


def good_units(spikes: DataFrame, labels: DataFrame) -> DataFrame:
    """The spikes of units labelled good."""
    return spikes.join(labels.where("label = 'good'").select("unit").distinct(), "unit", "left_semi")


def camera(spark: SparkSession, path: str) -> DataFrame:
    """path, row, flag, frame, ts of white-space separated logs with at least three columns."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), F.split(F.trim("value"), r"\s+").alias("f"))
    n = lambda i, t: F.expr(f"try_cast(get(f, {i}) AS {t})")
    return lines.where("size(f) >= 3").select("path", "row", n(0, "double").alias("flag"), n(1, "double").cast("long").alias("frame"), n(2, "double").alias("ts")).where("ts IS NOT NULL")


def sync(spark: SparkSession, path: str) -> DataFrame:
    """Sync documents: warp, events, metadata."""
    return spark.read.schema(SYNC_SCHEMA).json(path, multiLine=True)


def sync_json(stretch: Column, offset: Column, rmse: Column, events: Column, metadata: Column) -> Column:
    """A sync document as JSON text."""
    return F.to_json(F.struct(F.struct(stretch.alias("stretch"), offset.alias("offset"), rmse.alias("rmse")).alias("warp"), events.alias("events"), metadata.alias("metadata")))


def upsert_features(cache: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The cache with the features of ``new`` put in place of its own."""
    return cache.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_features(df: DataFrame, path: str) -> None:
    """Features as Parquet, one folder each; only the folders of features in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(path)


def optional_meta(spark: SparkSession, recordings: DataFrame, paths: DataFrame) -> DataFrame:
    """recordings (recording: a path) with fields of the sidecar of the same name with .meta, an empty map where there is none.

    paths has the rows of ``meta`` (path, fields).
    """
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"\.(bin|meta)$", "")
    own = paths.select(stem("path").alias("_stem"), "fields")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return recordings.withColumn("_stem", stem("recording")).join(own, "_stem", "left").withColumn("fields", F.coalesce("fields", none)).drop("_stem")


def sampling_rate(path: str | Column, fields: str | Column, policy: str = "meta_first") -> Column:
    """Samples a second: by "meta_first" the sidecar's, else 2500 for .lf. recordings and 30000; by "name_first" 2500 for .lf. whatever the sidecar says."""
    if policy not in ("meta_first", "name_first"):
        raise ValueError("policy must be meta_first or name_first")
    p, f = (F.col(c) if isinstance(c, str) else c for c in (path, fields))
    told = F.try_element_at(f, F.lit("imSampRate")).cast("double")
    slow = F.when(F.lower(p).contains(".lf."), F.lit(2500.0))
    return F.coalesce(slow, told, F.lit(30000.0)) if policy == "name_first" else F.coalesce(told, slow, F.lit(30000.0))


def recording_sizes(spark: SparkSession, path: str, n_channels: int) -> DataFrame:
    """recording, n_samples from the files' actual sizes (whole samples of 16-bit numbers); contents aren't read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("recording"), F.floor(F.col("length") / (2 * n_channels)).cast("long").alias("n_samples"))


def extragood_units(spark: SparkSession, path: str) -> DataFrame:
    """unit of a tab-separated table with cluster_id and a column whose name holds extragood, where that is y; no rows if the file is absent."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.csv(path, sep="\t", header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "unit int")
    names = {c.strip().lower(): c for c in df.columns}
    flag = next((c for k, c in names.items() if "extragood" in k), None)
    if flag is None or "cluster_id" not in names:
        raise ValueError("no cluster_id with extragood")
    yes = F.lower(F.trim(F.col(f"`{flag}`"))) == "y"
    return df.where(yes).select(F.expr(f"try_cast(`{names['cluster_id']}` AS int)").alias("unit"))


def flagged(units: DataFrame, extragood: DataFrame, unit: str = "unit") -> DataFrame:
    """units with ``extragood``, whether the unit is in that list; a left join."""
    own = extragood.select(F.col(unit), F.lit(True).alias("_yes")).distinct()
    return units.join(own, unit, "left").withColumn("extragood", F.coalesce("_yes", F.lit(False))).drop("_yes")


def sessions(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """group, setup, and a path for each of ``kinds`` (a name and a pattern of file names): the first file that matches in each folder root/group/setup.

    Folders that lack one of them are left out. Only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("group"), F.element_at(parts, -2).alias("setup"), F.element_at(parts, -1).alias("name"), "path")
    found = named.groupBy("group", "setup").agg(*[F.min(F.when(F.col("name").rlike(p), F.col("path"))).alias(k) for k, p in kinds.items()])
    return found.dropna(subset=list(kinds))


def feature_names(df: DataFrame, key: str) -> DataFrame:
    """df with kind and feature of a cache's keys: trace_x, time_x, rate_x and sync_x by their prefix, keys without one as traces of that name."""
    kind = F.regexp_extract(key, "^(trace|time|rate|sync)_", 1)
    return df.withColumn("kind", F.when(kind == "", "trace").otherwise(kind)).withColumn("feature", F.regexp_replace(key, "^(trace|time|rate|sync)_", ""))


def spike_times(times: DataFrame, clusters: DataFrame, rate: float) -> DataFrame:
    """unit, t (seconds) of spikes whose sample (row, time) and cluster (row, cluster) are given by two arrays; an error if they differ in length."""
    a, b = times.agg(F.count("*")).first()[0], clusters.agg(F.count("*")).first()[0]
    if a != b:
        raise ValueError(f"{a} spike times, but {b} clusters")
    return times.select("row", "time").join(clusters.select("row", "cluster"), "row").select(F.col("cluster").alias("unit"), (F.col("time") / rate).alias("t"))


def write_csv(df: DataFrame, path: str) -> None:
    """A table (a sweep, unit scores, a summary) as CSV files with a header, a file for each partition."""
    df.write.mode("overwrite").csv(path, header=True)


def write_diagnostics(df: DataFrame, path: str) -> None:
    """Diagnostics (session, and whatever belongs to it) as Parquet by session; only sessions in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
