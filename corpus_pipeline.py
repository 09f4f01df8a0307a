"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

Documents that score as toxic go; repeated lines go; of near copies one document stays; repeated
passages go; what is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_dedup as lines
from textloom.llm import ngram_join as near
from textloom.llm import packing as packs
from textloom.llm import substring_dedup as passages
from textloom.llm import toxicity as toxic
from textloom.llm.shared import restored, staged


#: A column of its own for a hash of the text.
KEY = "corpus_pipeline_text_key"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in one with a smaller doc_id."""
    return recounted(restored(lines.line_dedup(docs, keep_columns=True), docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that with the smallest doc_id; documents without words stay."""
    found = staged(near.ngram_join(docs), "near")
    keyed = docs.withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[KEY] == other["text_key"])
    gone = found.where("NOT kept").select("doc_id", "text_key").distinct()
    left = keyed.join(gone, same(gone), "left_anti")
    # Rows that repeat both doc_id and text of the one that stays are one document too.
    again = found.where("kept AND n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if not again.isEmpty():
        once = left.join(again, left["doc_id"].eqNullSafe(again["doc_id"]) & (left[KEY] == again["text_key"]), "left_semi").dropDuplicates(["doc_id", KEY])
        left = left.join(again, left["doc_id"].eqNullSafe(again["doc_id"]) & (left[KEY] == again["text_key"]), "left_anti").unionByName(once)
    return left.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows of 20 that also start earlier."""
    return recounted(restored(passages.substring_dedup(docs, keep_columns=True), docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packs.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def recounted(docs: DataFrame) -> DataFrame:
    """With n_chars, where there is such a column, as the texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The Kneser-Ney models and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
