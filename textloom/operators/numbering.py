"""Positions and running sums within groups of any size.

Rows are sorted by group and order over range partitions, so that a large group lies in several of them; each counts its own rows, and
what stands before it is added from one row a partition and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from textloom.sources.scratch import scratch_path

#: Rows that one range partition is meant to hold.
PART_ROWS = 200_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], amount: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``pos``, from 0 in the order ``order`` within their keys, and with ``amount`` also ``before``, the sum of that column over
    the earlier rows. Rows with equal keys and order are numbered in an order of their own."""
    spark, fields = rows.sparkSession, rows.schema.fields
    parts = max(1, -(-rows.count() // part_rows))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]] + [F.col("_salt").asc()]
    # The salt lets a range end between rows that are equal in all else.
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, total = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            new = np.array([a != b for a, b in zip(key, [last, *key[:-1]], strict=True)])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            pos = np.where(starts >= 0, np.arange(len(key)) - starts, at + np.arange(len(key)))
            arrays, names = [*batch.columns, pa.array(pos)], [*batch.schema.names, "_pos"]
            if amount:
                size = batch.column(amount).cast(pa.int64()).fill_null(0).to_numpy()
                sums = np.r_[0, np.cumsum(size)]
                before = np.where(starts >= 0, sums[:-1] - sums[np.maximum(starts, 0)], total + sums[:-1])
                arrays, names = [*arrays, pa.array(before)], [*names, "_before"]
                total = int(before[-1] + size[-1])
            last, at = key[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = [StructField("_part", IntegerType()), StructField("_pos", LongType()), *([StructField("_before", LongType())] if amount else [])]
    path = scratch_path(spark, "numbered")
    ranged.mapInArrow(run, StructType([*fields, *more])).write.parquet(path)
    found = spark.read.parquet(path)
    sums = [F.count(F.lit(1)).alias("_n"), *([F.sum(F.coalesce(F.col(amount).cast("long"), F.lit(0))).alias("_sum")] if amount else [])]
    totals = found.groupBy("_part", *keys).agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (("_n", "_base"), ("_sum", "_base_sum")) if c == "_n" or amount]
    bases = totals.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *bases)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = found.join(bases, same)
    out = [*(F.col(f.name) for f in fields), (F.col("_base") + F.col("_pos")).alias("pos")]
    return placed.select(*out, *([(F.col("_base_sum") + F.col("_before")).alias("before")] if amount else []))
