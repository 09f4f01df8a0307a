"""What several operators share: the shared folder, staged tables and blocks of documents."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.slices import give_back
from textloom.sources.scratch import remove, scratch_path as new_path


def staged(df: DataFrame, name: str, after: list[DataFrame] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: it cuts the lineage, and losing
    an executor afterwards costs nothing that was computed before. Staged tables in ``after`` are removed
    then; nothing else may need them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for old in after or ():
        remove(df.sparkSession, old.inputFiles()[0].rpartition("/")[0]) if old.inputFiles() else None
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, by one aggregate; it sizes blocks and buckets, never what is kept."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def blocks(docs: DataFrame, n_bytes: int, block_bytes: int, least: int = 32, keep_columns: bool = False) -> DataFrame:
    """(block, named, rank, doc_id, text): documents dealt by a hash of ``rank`` to blocks of about ``block_bytes``;
    with ``keep_columns`` also ``rest``, a struct of all other columns if there are any. ``rank`` is the doc_id,
    and for rows without one (``named`` is false) a hash of the text, so that many of them do not meet in one
    block and have an order of their own however many blocks there are."""
    n = max(least, math.ceil(n_bytes / block_bytes))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rank = F.coalesce(doc_id, F.xxhash64(text))
    columns = [F.pmod(F.xxhash64(rank), F.lit(n)).cast("int").alias("block"), doc_id.isNotNull().alias("named"), rank.alias("rank"), doc_id.alias("doc_id"), text.alias("text")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(*columns, *([F.struct(*rest).alias("rest")] if keep_columns and rest else []))


def restored(found: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents again, from doc_id, text and ``rest``."""
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns))


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def rows_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table; ``schema``: names and types as in Spark's DDL."""
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def ordered(docs: pa.Table) -> pa.Table:
    """A block's rows in an order that does not depend on how they arrived: those without a doc_id first. What the block before needed is given back."""
    give_back()
    return docs.sort_by([("named", "ascending"), ("rank", "ascending"), ("text", "ascending")])
