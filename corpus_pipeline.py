"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and returns those it keeps, with the columns of ``documents``; the last
returns the packed pieces. Decisions take effect: rejected documents and
duplicates go, repeated passages and personal data leave the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import jaccard, language, packing, pii, suffix
from kindred.llm.common import delete, documents, shared_folder, until_exit


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no n-gram of any language, go."""
    return language.filter_language(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word n-grams, similarity of 0.8 or more."""
    return jaccard.near_duplicates(docs, n=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; bytes that a 100-byte string covers which starts earlier, too, go.
    Null and empty texts stay as they are, n_chars is renewed."""
    return suffix.remove_repeats(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each personal span becomes [KIND], n_chars is renewed."""
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of each document, null texts as empty ones, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Learned models, components and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. Each stage's result is a table in the folder that the
    cluster shares; it goes when the next one is written, the last when the driver ends."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = f"{base}/{k}-{name}"
        made.write.parquet(path)
        if before is None:
            until_exit(spark, base)
        else:
            delete(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
