"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
it kept; all but the last return the columns of documents, whatever further
columns there are. An empty table gives an empty one in every stage. Null and
empty texts have no recognised language, so they go in the first stage; a
later stage that meets them treats both as the text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged
from spindrift.llm import langid, mixing, packing, secrets, simhash

#: Fewer words in packing's memory than by default: workers keep it while the executor's heap is full from the stages before.
REMEMBERED = 60_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, and repeated rows each; null texts and texts without a letter go."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity of 0.8 or more), by SimHash and then by shared shingles.

    That is the one with the smallest doc_id, null last; of rows with equal
    doc_id and text one stays. Texts without words are one group.
    """
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets masked and its length counted anew; null texts stay null."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mix takes, as many times as it takes them.

    Null is a source of its own. Equal rows are interchangeable; ties between others are settled by their contents.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences; a text without words, or null, is the closing id alone, and each repeated row is packed."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Learned models, fingerprints and differencing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
