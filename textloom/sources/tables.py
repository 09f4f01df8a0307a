"""Reading the input tables with Spark, so that any path Spark can open will do."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stated(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small table that is stated in the code. It is part of the plan; rows given as a list would be read by Python workers of their own, beside those of the texts."""
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=columns))
