"""Sample-interleaved int16 recordings as a Spark data source, read in chunks with channel pruning."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Chunk(InputPartition):
    def __init__(self, first: int, last: int, load_first: int, load_last: int):
        self.first, self.last, self.load_first, self.load_last = first, last, load_first, load_last


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options["nchannels"])
        self.channels = [int(c) for c in options.get("channels", "").split(",") if c.strip()] or list(range(self.n))
        self.chunk, self.overlap = int(options.get("chunksamples", 900_000)), int(options.get("overlap", 0))

    def partitions(self) -> list[Chunk]:
        total = os.path.getsize(self.path) // (2 * self.n)
        return [Chunk(a, min(a + self.chunk, total), max(0, a - self.overlap), min(total, a + self.chunk + self.overlap)) for a in range(0, total, self.chunk)]

    def read(self, part: Chunk | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an empty file has no partitions
            return
        step = 50_000
        schema = RecordingSource.arrow()
        with open(self.path, "rb") as f:
            for at in range(part.load_first, part.load_last, step):
                n = min(step, part.load_last - at)
                f.seek(2 * self.n * at)
                rows = np.frombuffer(f.read(2 * self.n * n), dtype="<i2").reshape(-1, self.n)[:, self.channels]
                sample = np.arange(at, at + len(rows))
                values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(self.channels), dtype=np.int32), pa.array(np.ascontiguousarray(rows).ravel()))
                inner = (sample >= part.first) & (sample < part.last)
                chunk = np.full(len(rows), part.first // self.chunk)
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(sample), pa.array(inner), values], schema=schema)


class RecordingSource(DataSource):
    """chunk, sample, core (false in the overlap), channels. The path must be one that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "int16_recording"

    @staticmethod
    def arrow() -> pa.Schema:
        return pa.schema([("chunk", pa.int64()), ("sample", pa.int64()), ("core", pa.bool_()), ("channels", pa.list_(pa.int16()))])

    def schema(self) -> str:
        return "chunk long, sample long, core boolean, channels array<short>"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader({k.lower(): v for k, v in self.options.items()})


def read_recording(spark: SparkSession, path: str, n_channels: int, **options) -> DataFrame:
    spark.dataSource.register(RecordingSource)
    return spark.read.format("int16_recording").options(path=path, nChannels=n_channels, **options).load()


#: Samples that travel together.
PIECE = 4096
_FORMAT = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"


def read_stored_recording(spark: SparkSession, path: str, n_channels: int, chunk: int = 900_000, overlap: int = 0, channels: list[int] | None = None) -> DataFrame:
    """chunk, sample, core, channels of a recording in any store that Hadoop reads, in place of one that every executor mounts.

    Splits are byte ranges of whole samples, which tasks read side by side; a
    split's samples go on in pieces of PIECE, with the channels asked for
    only, each to the chunks that it touches. So it takes one shuffle, and
    each chunk is whole and in order in one partition. Bytes after the last
    whole sample are an error of the format.
    """
    own = list(range(n_channels)) if channels is None else list(channels)
    width = 2 * n_channels
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    total = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() // width
    schema = "chunk long, first long, body binary"
    if not total:
        return spark.createDataFrame([], RecordingSource({}).schema())
    last = (total - 1) // chunk

    def pieces(records):
        held: list[bytes] = []
        first = 0

        def closed():
            rows = np.frombuffer(b"".join(held), dtype="<i2").reshape(-1, n_channels)[:, own]
            end = first + len(rows) - 1
            for c in range(max(0, (first - overlap) // chunk), min(last, (end + overlap) // chunk) + 1):
                low, high = max(first, c * chunk - overlap), min(end + 1, (c + 1) * chunk + overlap)
                if high > low:
                    yield c, low, np.ascontiguousarray(rows[low - first : high - first]).tobytes()

        for offset, record in records:
            if not held:
                first = offset // width
            held.append(bytes(record))
            if len(held) == PIECE:
                yield from closed()
                held.clear()
        if held:
            yield from closed()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, first, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                rows = np.frombuffer(body, dtype="<i2").reshape(-1, len(own))
                sample = np.arange(first, first + len(rows))
                values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(own), dtype=np.int32), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c)), pa.array(sample), pa.array(sample // chunk == c), values], schema=RecordingSource.arrow())

    conf = {"fixedlengthinputformat.record.length": str(width)}
    records = spark.sparkContext.newAPIHadoopFile(path, _FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    found = spark.createDataFrame(records.mapPartitions(pieces), schema)
    dealt = found.repartition(int(min(last + 1, 10_000)), "chunk").sortWithinPartitions("chunk", "first")
    return dealt.mapInArrow(unpacked, RecordingSource({}).schema())


def read_npy_longs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, row, value of one-dimensional int64 .npy files, in a task for each file, through Spark's own file reader."""

    def rows(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = int.from_bytes(content[8:10], "little")
                head = content[10 : 10 + size].decode("latin-1")
                kind = head.split("'descr':")[1].split("'")[1]
                x = np.frombuffer(content, dtype=kind, offset=10 + size).astype(np.int64)
                for a in range(0, len(x), 1_000_000):
                    part = x[a : a + 1_000_000]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part)], ["path", "row", name])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInArrow(rows, f"path string, row long, {name} long")
