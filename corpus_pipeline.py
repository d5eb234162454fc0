"""From raw documents to packed sequences: language ID, near-deduplication, passage deduplication, packing.

Stages take and give the columns of documents; other columns are dropped by the first one. Rows without a doc_id go through
like others; they count as one key. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import language_id, near_dedup, packing, passages
from gatewright.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null texts and texts without a letter. The classifier learns
    from the labelled documents it is given."""
    model = language_id.train(docs, "doc_id", "text", "lang", F.lit(True))
    return language_id.predict(docs.select(*COLUMNS), "doc_id", "text", model).where(F.col("lang_pred") != language_id.UND).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dedup.deduplicate(docs.select(*COLUMNS), "doc_id", "text")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes paragraphs and passages that an earlier document holds; documents of which no word is left go."""
    cleaned = passages.clean(docs.select(*COLUMNS), "doc_id", "text")
    left = (F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; one row per piece."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", identify), ("near_dedup", deduplicate), ("substring_dedup", cut_passages), ("packing", pack)]

#: The classifier, the clustering of near duplicates and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
