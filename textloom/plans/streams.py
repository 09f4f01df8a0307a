"""Queries that run as streams over the files of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.sources.scratch import scratch_path
from textloom.sources.tables import table
from textloom.streaming.resume import resume

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def resume_stream(spark, sf):
    """Pending documents counted as they are processed, file by file, with a checkpoint to go on from."""
    schema = ", ".join(f"`{n}` {t}" for n, t in table(spark, sf, "documents").dtypes)
    sink, seen = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    work = lambda rows: rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")).where("chars > 0")
    single = any(f.endswith("/documents.parquet") for f in table(spark, sf, "documents").inputFiles())  # a table of one file
    source, names = (sf, "documents.parquet") if single else (f"{sf}/documents.parquet", "*")
    query = resume(spark, source, schema, work, sink, seen, names=names)
    query.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "chars")


QUERIES["resume_stream"] = resume_stream
ORACLES["resume_stream"] = "SELECT doc_id, length(text)::INT AS chars FROM documents WHERE coalesce(text, '') <> ''"
