"""Column rules that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def read_documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a text column, b"" for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches, rows: int = 256, size: int = 2 << 20):
    """The same rows in smaller batches of about ``size`` bytes at most, which bound what a task holds besides its input."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def over_rows(docs: DataFrame, change) -> DataFrame:
    """docs with change(batch, place of text in it), which keeps the columns, over all rows in small batches."""
    at = [c.lower() for c in docs.columns].index("text")

    def rows(batches):
        for batch in sliced(batches):
            yield change(batch, at)

    return docs.mapInArrow(rows, docs.schema)
