"""The driver's tables as chapters.

The mapping is an adaptation: a document is a chapter of the project named by its source; a label
says how far it got. Toxic ones are not fetched yet, good ones are translated, bad ones failed, and
unlabelled ones are downloaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.chapters import conformed
from textloom.sources.tables import table

CHAPTERS_SQL = """
ch AS (SELECT d.source AS project, d.doc_id AS idx, string_split(coalesce(d.text, ''), chr(10))[1] AS title, 'https://' || d.source || '.example/' || d.doc_id AS url,
  CASE WHEN l.toxic = 1 THEN '' ELSE coalesce(d.text, '') END AS content,
  CASE WHEN l.toxic = 0 AND l.quality = 1 THEN coalesce(d.text, '') ELSE '' END AS translated,
  CASE WHEN l.toxic = 0 AND l.quality = 1 THEN d.lang ELSE '' END AS target_lang,
  CASE WHEN l.toxic = 1 THEN 'pending' WHEN l.quality = 1 THEN 'translated' WHEN l.quality = 0 THEN 'error' ELSE 'downloaded' END AS status,
  CASE WHEN l.toxic = 0 AND l.quality = 1 AND d.n_chars > 1000 THEN 'audio/' || d.doc_id || '.mp3' ELSE '' END AS audio_path,
  d.lang AS audio_voice, CASE WHEN d.n_chars > 2000 THEN 'original' ELSE 'translated' END AS audio_source, d.n_chars / 15.0 AS audio_seconds
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce((F.col("toxic") == 0) & (F.col("quality") == 1), F.lit(False))
    return conformed(
        rows.select(
            F.col("source").alias("project"), F.col("doc_id").alias("idx"), F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
            F.when(F.col("toxic") == 1, "").otherwise(F.col("text")).alias("content"), F.when(good, F.col("text")).otherwise("").alias("translated"), F.when(good, F.col("lang")).otherwise("").alias("target_lang"),
            F.when(F.col("toxic") == 1, "pending").when(F.col("quality") == 1, "translated").when(F.col("quality") == 0, "error").otherwise("downloaded").alias("status"),
            F.when(good & (F.col("n_chars") > 1000), F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit(".mp3"))).otherwise("").alias("audio_path"), F.col("lang").alias("audio_voice"),
            F.when(F.col("n_chars") > 2000, "original").otherwise("translated").alias("audio_source"), (F.col("n_chars") / 15.0).alias("audio_seconds"),
        )
    )
