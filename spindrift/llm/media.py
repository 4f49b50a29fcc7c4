"""Media columns: FLAC streams to checked PCM blocks, and payloads stored as FLAC.

Null texts and media count as empty. Repeated rows give repeated, equal rows;
other columns are ignored; an empty table gives an empty one. A stream whose
checksums don't hold raises an error, as its samples would be wrong.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import flac
from spindrift.llm.columns import sliced, texts

ALIGN = 64


def payload(raw: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of ALIGN."""
    return raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def encoded(docs: DataFrame, lpc_order: int = 0) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream of 8-bit samples."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = texts(batch.column(1))
            media = [flac.encode(payload(x), lpc_order=lpc_order) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, n_samples, stream_offset, pcm of each frame of (doc_id, media)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "block", "first_sample", "n_samples", "stream_offset", "pcm"]
        for batch in sliced(batches):
            streams = [x or flac.encode(b"") for x in batch.column(1).to_pylist()]
            for doc_id, data, blocks in zip(batch.column(0).to_pylist(), streams, flac.decode_many(streams), strict=True):
                places = flac.seeks(data, [a for a, _ in blocks])
                own = [(doc_id, i, a, len(p), at, p) for i, ((a, p), at) in enumerate(zip(blocks, places, strict=True))]
                kinds = [pa.int64()] * 5 + [pa.binary()]
                columns = list(zip(*own, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, block long, first_sample long, n_samples long, stream_offset long, pcm binary"
    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(rows, schema)


def feature(pcm: bytes) -> str:
    """Whole-number features of the samples: energy, peak, sign changes, and the sum of absolute steps."""
    x = (np.frombuffer(pcm, dtype=np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    low = x < 0
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={int((low[1:] != low[:-1]).sum())};steps={int(np.abs(np.diff(x)).sum())}"


def stored(docs: DataFrame) -> DataFrame:
    """Each text's payload stored as FLAC and read back: sizes, digests and features of what was read.

    n_blocks are the PCM blocks, n_seekable the different places where seeking their first samples leads.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, n_seekable long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.replace(",", "").split()[::2]
        for batch in sliced(batches):
            out = []
            streams, sizes = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for doc_id, n, data, blocks in zip(batch.column(0).to_pylist(), sizes, streams, flac.decode_many(streams), strict=True):
                pcm = b"".join(p for _, p in blocks)
                out.append((
                    doc_id, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-ALIGN:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature(pcm), len(blocks),
                    len(set(flac.seeks(data, [a for a, _ in blocks]))),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return encoded(docs).mapInArrow(rows, schema)
