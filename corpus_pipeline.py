"""The corpus pipeline: from raw documents to packed sequences, each stage written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, pii
from tidemark.llm.minhash import deduplicated
from tidemark.llm.mixing import mixture, shuffled, whole_rows
from tidemark.llm.packing import pack
from tidemark.llm.shared import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shard that the mix is dealt to.
SHARD_WORDS = 1 << 22


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or mostly in other languages go.

    A NULL text has no letters. Rows are judged by their text alone, so repeated rows stay or go together; NULLs in other
    columns stay as they are.
    """
    docs = docs.select(*COLUMNS)
    rows = langid.training_rows(docs)
    model = langid.fit(rows)
    return langid.accepted(docs, model, langid.floors(model, rows))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, and one row of it.

    Documents without words and rows with a NULL id are in no group and stay. NULLs in other columns stay as they are.
    """
    return deduplicated(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds.

    All rows stay, in any number; a NULL text becomes an empty one, and n_chars counts the new text.
    """
    docs = docs.select(*COLUMNS)
    found = pii.personal_data(docs, pii.fit(pii.training_texts(docs)), keep=("lang", "source"))
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars")
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, always whole, by shard in the shard's random order.

    A source's words lie within half a document of its target. Documents without words are drawn never, NULL sources are a
    source of their own, and rows that repeat an id count each.
    """
    return shuffled(whole_rows(mixture(docs.select(*COLUMNS), keep=COLUMNS, shard_words=SHARD_WORDS))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn documents with their places in sequences; a row that is drawn twice is packed twice."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the last has a SQL form; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
