"""Numbering of rows in an order over the whole table, though some keys may hold a large share of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The last sorting key: it lets a range partitioning cut between rows that are equal in all others.
SALT = "textloom_salt"


def ranged(rows: DataFrame, keys: list[Column], parts: int) -> DataFrame:
    """``rows`` sorted by ``keys``, nulls first, over ``parts`` partitions that are ranges of them. Rows with equal keys come in
    an order of their own, and a range may end between them; ``keys`` should leave equal only rows that may trade places."""
    by = [k.asc_nulls_first() for k in [*keys, F.col(SALT)]]
    return rows.withColumn(SALT, F.monotonically_increasing_id()).repartitionByRange(max(1, parts), *by).sortWithinPartitions(*by).drop(SALT)


def parts_for(amount: int, each: int, least: int = 12) -> int:
    return max(least, math.ceil(amount / each))


def before(totals: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``totals`` with the sum of ``amount`` over the earlier rows of the group in ``name``. A row stands for a partition or
    file, not for a row of the corpus."""
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(amount).over(over), F.lit(0)))
