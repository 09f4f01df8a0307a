"""Resumable incremental work: each micro-batch of pending rows is processed and committed, and a query that starts
again goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resume(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1, names: str = "*") -> StreamingQuery:
    """Applies ``work`` to the Parquet files of the folder ``source`` whose names match ``names`` and that no earlier run has taken, and appends to ``sink``; a
    batch that is repeated after a failure overwrites its own folder, so nothing is written twice."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(source)
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
