"""The registered queries of this subpackage: each applies an operator, with the
parameters it is meant for, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import fingerprints, gif, jaccard, language, packing, pieces, pii, sharding, suffix, toxicity
from kindred.llm.common import documents, held_out


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = language.identify(docs, language.train(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_chain(documents(spark, sf_dir))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(documents(spark, sf_dir))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats_digest(documents(spark, sf_dir))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_fingerprints, op3_gif_media, op4_sentencepiece_sampling, op5_toxicity, op6_best_fit_packing, op7_suffix_dedup, op8_rendezvous_sharding, op9_pii, op10_ngram_jaccard_join)
}

#: None of these can be said in DuckDB's SQL: they rest on crc32, xxhash64, learned
#: models, tokenizers or components. tests/llm holds each against a plain version.
ORACLE_SQL: dict[str, str] = {}
