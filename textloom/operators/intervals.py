"""Points within ranges, whatever the ranges' widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, lo, hi) of the ranges of whole numbers with those that overlap or touch made one. Ranges whose ends are in the wrong order are empty."""
    rows = ranges.where(F.col(lo) <= F.col(hi)).select(*keys, F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.coalesce(F.col("lo") > reach + 1, F.lit(True)), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def binned(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, level, bin): a range is cut at bins as wide as the next power of two above its length, so it lies in two at most."""
    level = F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")
    sized = ranges.withColumn("level", level)
    width = F.expr("shiftleft(1L, level)")
    return sized.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))))


def within(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The rows of ``points`` whose ``point`` lies in a range (keys, lo, hi; ends included) of the same keys, each once; a null lies in none.

    Ranges are made disjoint and joined by bins, and the ends are compared after. A range of a million numbers thus costs no more rows than one of
    two, and a point one row for each width of bins that there is. Keys must not be null."""
    bins = binned(merged(ranges, keys, lo, hi), keys)
    levels = sorted(r[0] for r in bins.select("level").distinct().collect())  # 64 at most
    asked = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns), F.explode(F.array(*map(F.lit, levels or [0]))).alias("p_level"))
    at = F.floor(F.col(f"p_{point}").cast("long") / F.expr("shiftleft(1L, p_level)"))
    same = [F.col(f"p_{k}") == F.col(k) for k in keys]
    hit = asked.withColumn("p_bin", at).join(bins, [*same, F.col("p_level") == F.col("level"), F.col("p_bin") == F.col("bin"), F.col(f"p_{point}").between(F.col("lo"), F.col("hi"))], "left_semi")
    return hit.select(*(F.col(f"p_{c}").alias(c) for c in points.columns))
