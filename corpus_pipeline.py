"""Corpus pipeline over ``documents``: filter, deduplicate, redact, pack.

Each stage reads all its predecessor kept, and its decisions take effect: all but
the last return the columns of ``documents``, the last one row a packed piece.
Rows that repeat a doc_id are kept or dropped by their own text; a null doc_id is
never a duplicate; a null text has no letter and goes at the first stage; columns
whose names an operator uses itself come back as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import contracts, crf_language, ngram_join, packing, pii, quality_gbt, shared

#: A document whose most likely language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter or without a clear language."""
    model = contracts.language_model(docs)
    label, score = shared.fresh(docs, "lang_pred"), shared.fresh(docs, "score")
    found = crf_language.identify(docs, model, label, score)
    return found.where((F.col(label) != crf_language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier predicts as label 0."""
    model = contracts.quality_model(docs, contracts.table(spark, sf_dir, "labels"))
    score = shared.fresh(docs, "score")
    return quality_gbt.score(docs, model, score).where(F.col(score) >= contracts.QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group, one row of it.

    A row is found by doc_id and text: rows of one doc_id may be in several groups.  Equal
    rows are one before the texts move, which they do once, to their groups' decisions.
    """
    key = shared.fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    groups = ngram_join.components(keyed.select("doc_id", "text", key), extra=key)
    alone = F.when(F.col("component").isNull(), F.col(key)).alias("alone")  # an empty set links with nothing
    kept = groups.where("doc_id = component_id").groupBy("doc_id", "component", alone).agg(F.min(key).alias(key)).select("doc_id", key).distinct()
    one = keyed.where("doc_id is not null").dropDuplicates(["doc_id", key]).join(kept.hint("merge"), ["doc_id", key])
    return one.unionByName(keyed.where("doc_id is null")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each span of personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents' tokens to sequences."""
    return packing.pack(docs, contracts.tokenizer_path("byte_bpe_50k.json"), end_id=1)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]

#: Trained models and tokenizers stand between the rows and SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.materialise(stage(spark, docs, sf_dir), name)
        shared.drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
