"""The operators applied to the given tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import extraction, langid, pii
from tidemark.llm.ball_search import ranked_search
from tidemark.llm.chat import START, digests, format_conversations
from tidemark.llm.embeddings import near_vectors
from tidemark.llm.media import media_columns
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mixture, with_places
from tidemark.llm.packing import pack
from tidemark.llm.secret_scan import secret_spans
from tidemark.llm.token_alignment import aligned_tokens
from tidemark.llm.vector_packing import pack_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(langid.training_rows(docs)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(pii.training_texts(docs)), redacted=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(extraction.training_pages(pages)))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"<|im_end|>{START}assistant ok"
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.union(hard)))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_places(mixture(table(spark, sf_dir, "documents")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_vectors(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_minhash_near_dedup,
        op3_embedding_near_dedup,
        op4_personal_data,
        op5_html_extraction,
        op6_chat_formatting,
        op7_best_fit_packing,
        op8_source_mixing,
        op9_media_columns,
        op10_secret_scan,
        op11_vector_packing,
        op12_token_alignment,
        op13_ranked_search,
    )
}
ORACLES: dict[str, str] = {}
