"""Rows of long sequences in order, without a task that needs a whole sequence.

A range partitioning by key and order gives each task a contiguous range of
rows, so a key with a third of all rows spreads over many tasks. A task's
rows of one key are a run; runs of a key follow each other by ``part``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import staged


def text_key(c: Column) -> Column:
    """An id as text that joins can compare; null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def from_key(key: str) -> Column:
    return F.when(F.col(key) != "", F.col(key).cast("long"))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df by ranges of order (nulls first), sorted in each; equal rows are told apart by their place in the input, so copies spread too."""
    by = [F.col(c).asc_nulls_first() for c in (*order, "_place")]
    return df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_place")


def part_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def hashed(pieces: DataFrame, key: str, order: tuple[str, ...], body: str, shown: str | None = None, by: bytes = b"\n") -> DataFrame:
    """key, sha256 of its pieces' bodies (binary) in order with ``by`` between them, and its ``shown`` texts concatenated.

    Bodies that are empty count as absent. A SHA-256 is a chain, so one task
    reads a key's pieces one after the other; it holds a batch of them, the
    hash and the shown text.
    """
    names = [key, body, *([shown] if shown else [])]
    schema = f"{key} string, sha256 string" + (f", {shown} string" if shown else "")

    def rows(batches):
        now, some, digest, texts = None, False, None, []
        out: list[tuple] = []

        def close():
            out.append((now, digest.hexdigest(), "".join(texts)))

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for k, b, *t in zip(*columns):
                if k != now or digest is None:
                    if digest is not None:
                        close()
                    now, some, digest, texts = k, False, hashlib.sha256(), []
                if b:
                    if some:
                        digest.update(by)
                    digest.update(b)
                    some = True
                texts += t
            if out:
                yield from _table(out, key, shown)
                out = []
        if digest is not None:
            close()
            yield from _table(out, key, shown)

    def _table(out, key, shown):
        columns = {key: [r[0] for r in out], "sha256": [r[1] for r in out]} | ({shown: [r[2] for r in out]} if shown else {})
        return pa.table({n: pa.array(v, pa.string()) for n, v in columns.items()}).to_batches()

    put = pieces.select(*dict.fromkeys([*names, *order])).repartition(key).sortWithinPartitions(key, *order)
    return staged(put.mapInArrow(rows, schema), "hashed")


def pieced(df: DataFrame, key: str, order: tuple[str, ...], body: str, by: bytes, size: int = 1 << 16) -> DataFrame:
    """key, part, nth, body: the bodies of a key's rows in order, joined with ``by`` to pieces of about ``size`` bytes; empty bodies are left out."""

    def rows(batches):
        part, now, nth, held, n = part_number(), None, 0, [], 0
        out: list[tuple] = []

        def close():
            if held:
                out.append((now, part, nth, by.join(held)))

        for batch in batches:
            for k, b in zip(batch.column(key).to_pylist(), batch.column(body).to_pylist()):
                if k != now or n >= size:
                    close()
                    now, nth, held, n = k, (nth + 1 if k == now else 0), [], 0
                if b:
                    held.append(b)
                    n += len(b)
            if out:
                yield from _pieces(out, key, body)
                out = []
        close()
        if out:
            yield from _pieces(out, key, body)

    placed = in_order(df.select(key, *order, body), key, *order)
    return staged(placed.mapInArrow(rows, f"{key} string, part long, nth long, {body} binary"), "pieces")


def _pieces(out: list[tuple], key: str, body: str) -> list[pa.RecordBatch]:
    k, part, nth, b = zip(*out)
    return pa.table({key: pa.array(k, pa.string()), "part": pa.array(part, pa.int64()), "nth": pa.array(nth, pa.int64()), body: pa.array(b, pa.binary())}).to_batches()
