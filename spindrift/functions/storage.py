"""Where intermediate tables go: the folder that all executors and the driver share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Held while a staged table is written: its shuffle files go when it is there, and batches for Python are bounded by bytes.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder of
    its own (kept in the session); on a cluster that is an error, as a folder
    of one machine would be of no use to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spindrift.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spindrift.scratch.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def _holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _place(df: DataFrame):
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and lost executors don't matter.

    The table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    with _holding(spark, WHILE_WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    files, at = _place(out)
    files.deleteOnExit(at)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        files, at = _place(df)
        files.delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, after a phase whose tables nothing refers to any more.

    Spark lets go of the shuffles and broadcasts of a finished query only when
    the driver collects what described them, and a heap that grew meanwhile shrinks then.
    """
    spark.sparkContext._jvm.System.gc()
