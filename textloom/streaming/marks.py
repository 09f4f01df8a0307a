"""The two-phase upload log as a stream: each file's state is kept by its key, and what was begun and never confirmed is told.

A file's ``sending`` mark is written before it goes out and its ``done`` mark after the store was seen to hold it. A mark that is still
``sending`` when the stream goes on after a stop is doubtful: nobody knows whether the file arrived.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.sources.scratch import exists, scratch_path

LOG = "file string, at long, status string, size long"
TOLD = "file string, at long, status string, size long, told string"
STATE = "at long, status string, size long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Marks(StatefulProcessor):
    """Keeps the latest mark of a file; marks that are older than what is known change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mark", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, status, size = self.state.get() if self.state.exists() else (None, "", None)
        before = status
        for batch in rows:
            for a, s, n in sorted(zip(batch["at"], batch["status"], batch["size"], strict=True)):
                if at is None or a >= at:
                    at, status, size = int(a), s, int(n)
        self.state.update((at, status, size))
        what = "new" if not before else "changed" if before != status else "again"
        yield pd.DataFrame({"file": [key[0]], "at": [at], "status": [status], "size": [size], "told": [what]})

    def close(self) -> None:
        pass


def marked(log: DataFrame) -> DataFrame:
    """What happens to files by a streaming log (file, at, status, size): a row for each file and batch with its latest mark and whether that is ``new``,
    ``changed`` or said ``again``."""
    return log.groupBy("file").transformWithStateInPandas(Marks(), TOLD, outputMode="Update", timeMode="None")


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Reads what is new in a folder of log files (Parquet) and appends what happened to ``sink``; it goes on where the last run stopped. Files that the
    last run left ``sending`` are told first, as ``unconfirmed``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if exists(spark, sink):
        open_ = known_states(told(spark, sink)).where("status = 'sending' AND NOT unconfirmed")
        # Written elsewhere first: it is read from where it goes.
        path = scratch_path(spark, "unconfirmed")
        open_.select("file", "at", "status", "size", F.lit("unconfirmed").alias("told")).write.parquet(path)
        spark.read.parquet(path).write.parquet(f"{sink}/restart={uuid.uuid4().hex}")

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return marked(log).writeStream.foreachBatch(commit).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def told(spark: SparkSession, sink: str) -> DataFrame:
    """All that runs have told."""
    return spark.read.schema(TOLD).option("recursiveFileLookup", True).parquet(sink)


def known_states(told: DataFrame) -> DataFrame:
    """(file, at, status, size, unconfirmed) by all that was told: the latest mark, and whether it was told to be unconfirmed."""
    last = told.groupBy("file").agg(F.max(F.struct("at", (F.col("told") == "unconfirmed").alias("u"), "status", "size")).alias("m"))
    return last.select("file", "m.at", "m.status", "m.size", F.col("m.u").alias("unconfirmed"))
