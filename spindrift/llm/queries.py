"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import langid, licenses, lm, media, mixing, multi_index, packing, pii, quality, repair, secrets, simhash, sql, trie
from spindrift.llm.columns import read_documents


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_documents(spark, sf_dir), pii.key_of(spark))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_source(read_documents(spark, sf_dir))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(read_documents(spark, sf_dir))


def op9_embedding_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(read_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_source_mix, op3_lm_scores, op4_packing, op5_language_id,
        op6_license_scan, op7_simhash_pigeonring, op8_flac_media, op9_embedding_multi_index, op10_secret_scan, op11_conversation_repair, op12_conversation_trie, op13_quality_rules,
    )
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
