"""Incremental work whose items fail one by one: good items are kept, errors are written beside them, and a fatal error ends the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources.scratch import exists, scratch_path


class Stopped(RuntimeError):
    """A run that ended on a fatal error; all before it is kept, and the next run goes on from there."""


def settle(batch: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, order: str, folder: str) -> None:
    """Does what is left of a batch. ``work`` adds ``error`` (empty for a good item) and ``fatal`` to the items, which are taken in the order of
    ``order``: good ones before the first fatal error go to ``folder``/good, errors up to it to ``folder``/errors, and items behind it are left. Items that an earlier
    try has settled are not done again."""
    spark = batch.sparkSession
    kind, recursive = batch.schema[key].dataType.simpleString(), spark.read.option("recursiveFileLookup", True)
    for part, settled in (("good", "true"), ("errors", "NOT fatal")):  # what was fatal then may go well now
        if exists(spark, f"{folder}/{part}"):
            done = recursive.schema(f"`{key}` {kind}, fatal boolean").parquet(f"{folder}/{part}").where(settled).select(key).distinct()
            batch = batch.join(done, key, "left_anti")
    path = scratch_path(spark, "settled")
    work(batch).write.parquet(path)
    tried = spark.read.parquet(path)
    fatal = tried.where("fatal").agg(F.min(F.struct(order, key, "error")).alias("f")).first()["f"]
    upto = tried if fatal is None else tried.where(F.col(order) < fatal[0])
    upto.where("error = ''").drop("error", "fatal").write.mode("append").parquet(f"{folder}/good")
    errors = upto.where("error <> '' AND NOT fatal")
    if fatal is not None:
        errors = errors.unionByName(tried.where(F.col("fatal") & (F.col(order) == fatal[0])))
    errors.select(*dict.fromkeys((key, order, "error", "fatal"))).write.mode("append").parquet(f"{folder}/errors")
    if fatal is not None:
        raise Stopped(f"{fatal[1]}: {fatal[2]}")


def guarded(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str, order: str, sink: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Applies ``work`` to the Parquet files of ``source`` batch by batch, as ``settle`` says; ``sink``/batch=<n> has the ``good`` items and the ``errors`` of a batch.

    A fatal error fails the query, and as its batch was not committed, the next run takes it again, without what was settled."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        settle(batch, work, key, order, f"{sink}/batch={batch_id}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
