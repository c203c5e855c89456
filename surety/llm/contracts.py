"""The thin ``opN_*`` queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import cover_tree, crf_language, merge_automaton, merkle, ngram_join, oracle, packing, pii, quality_gbt, token_files, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.token_file_digest(spark, folder)


URL_RULES = oracle.URL_RULES


def op2_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


#: Fixed value: the least score of label 1.
QUALITY_THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_gbt.BoostedTrees:
    """Fitted on the labels outside the held-out fold."""
    return quality_gbt.BoostedTrees.fit(*quality_gbt.training_table(docs, labels.where(~held_out(5, 0))))


def op3_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_gbt.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_digest(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.coding_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1)


def language_model(docs: DataFrame) -> crf_language.LanguageCrf:
    """Fitted on the labelled documents outside the held-out fold."""
    return crf_language.LanguageCrf.fit(crf_language.training_rows(docs.where(~held_out(3, 1) & F.col("doc_id").isNotNull())))


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = crf_language.identify(docs.select("doc_id", "text"), language_model(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_redirects, op3_quality_gbt, op4_merkle, op5_ngram_join, op6_merge_automaton, op7_packing, op8_crf_language, op9_pii, op10_cover_tree)}

SQL = oracle.SQL
