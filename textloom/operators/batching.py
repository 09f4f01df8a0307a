"""Greedy batches of the files of a folder, for folders of any length.

Where a batch ends depends on where it begins, and so on all files before it. But a batch holds ``max_files`` at most, so the first batch
to begin in a stretch of a folder begins at one of its first ``max_files`` places. Each stretch works out for each of these
places where the first batch behind the stretch then begins: a table of a few numbers, which two neighbouring stretches join into one
by looking the first's answers up in the second's. Doubling these tables tells every stretch its first place in a number of rounds that
grows with the logarithm of their number; then each stretch cuts its own batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered
from textloom.sources.scratch import written


def next_starts(sizes: np.ndarray, max_files: int, max_bytes: int) -> np.ndarray:
    """For each file the place behind the batch that begins with it: by binary search in the running sums."""
    sums = np.r_[0, np.cumsum(sizes)]
    place = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[:-1] + max_bytes, "right") - 1
    return np.minimum(np.maximum(fits, place + 1), place + max_files)


def cuts(sizes: np.ndarray, entry: int, stretch: int, max_files: int, max_bytes: int) -> list[tuple[int, int]]:
    """(begin, end) of the batches that begin in the stretch, the first at ``entry``."""
    after, out = next_starts(sizes, max_files, max_bytes), []
    while entry < min(stretch, len(sizes)):
        out.append((entry, int(after[entry])))
        entry = out[-1][1]
    return out


def batched(items: DataFrame, keys: list[str], order: list[str], max_files: int = 20, max_bytes: int = 4 << 30, stretch: int = 10_000, part_rows: int = 200_000) -> DataFrame:
    """(keys, batch, first, files, bytes): batches of the files (keys, order, size) of each folder in order, none over ``max_files`` or ``max_bytes``
    but a single file over the latter; ``first`` is the place of a batch's first file. A null size is 0."""
    stretch = max(stretch, max_files)
    size = F.coalesce(F.col("size").cast("long"), F.lit(0))
    rows = numbered(items.select(*keys, *order, size.alias("size")), keys, order, part_rows=part_rows).select(*keys, "pos", "size")
    own = (F.col("pos") / stretch).cast("long")
    # A stretch also sees the files behind it that a batch of its own may reach into.
    beside = F.when((F.col("pos") % stretch < max_files) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    task = F.pmod(F.xxhash64(*keys, "stretch"), F.lit(max(1, -(-items.count() // part_rows)))).cast("int")
    placed = written(rows.withColumn("stretch", F.explode(beside)).select(task.alias("task"), *keys, "stretch", (F.col("pos") - F.col("stretch") * stretch).cast("int").alias("at"), "size"), "stretches")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in keys)

    def each(table: pa.Table) -> Iterator[tuple[tuple, np.ndarray]]:
        """(keys and stretch, sizes in order) of the stretches in a task's rows."""
        table = table.sort_by([(c, "ascending") for c in [*keys, "stretch", "at"]])
        sizes = table.column("size").to_numpy()
        names = zip(*(table.column(c).to_pylist() for c in [*keys, "stretch"]), strict=True)
        begin = 0
        for name, own in itertools.groupby(names):
            n = sum(1 for _ in own)
            yield name, sizes[begin : begin + n]
            begin += n

    def as_table(out: list[tuple], like: pa.Schema, more: list[tuple[str, pa.DataType]]) -> pa.Table:
        kinds = [*((k, like.field(k).type) for k in keys), ("stretch", pa.int64()), *more]
        return pa.table([pa.array([row[i] for row in out], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    def exits(table: pa.Table) -> pa.Table:
        found = []
        for name, sizes in each(table):
            after = next_starts(sizes, max_files, max_bytes).tolist()
            out = [0] * len(sizes)
            for k in range(min(stretch, len(sizes)) - 1, -1, -1):
                out[k] = after[k] - stretch if after[k] >= stretch else out[after[k]] if after[k] < len(sizes) else 0
            found.append((*name, [max(0, x) for x in out[:max_files]]))
        return as_table(found, table.schema, [("exits", pa.list_(pa.int32()))])

    def cut(table: pa.Table, entries: pa.Table) -> pa.Table:
        known = dict(zip(zip(*(entries.column(c).to_pylist() for c in [*keys, "stretch"]), strict=True), entries.column("entry").to_pylist(), strict=True))
        out = []
        for name, sizes in each(table) if table.num_rows else ():
            sums = np.r_[0, np.cumsum(sizes)]
            for k, (begin, end) in enumerate(cuts(sizes, known.get(name, 0), stretch, max_files, max_bytes)):
                out.append((*name, k, name[-1] * stretch + begin, end - begin, int(sums[end] - sums[begin])))
        return as_table(out, table.schema if table.num_rows else entries.schema, [("batch", pa.int64()), ("first", pa.int64()), ("files", pa.int32()), ("bytes", pa.int64())])

    # Folders of one stretch begin at its first file; the others' stretches have to be told.
    long_ones = placed.where("stretch > 0").select(*keys).distinct()
    several = placed.join(long_ones.select(*(F.col(k).alias(f"_{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    jumps = written(several.groupBy("task").applyInArrow(exits, f"{types}, stretch long, exits array<int>"), "exits")
    entries = jumps.where("stretch = 0").select(*keys, "stretch", F.lit(0).alias("entry"))
    last, step = jumps.agg(F.coalesce(F.max("stretch"), F.lit(0))).first()[0], 1
    while step <= last:
        # Stretches up to ``step`` know their entry; the tables now lead ``step`` stretches on.
        there = beside_of(entries, jumps, keys, 0, ["exits"]).select(*keys, (F.col("stretch") + step).alias("stretch"), F.get("exits", F.col("entry")).alias("entry"))
        there = beside_of(there, jumps, keys, 0, [], "left_semi")
        entries = written(entries.unionByName(there), "entries")
        further = beside_of(jumps, jumps.withColumnRenamed("exits", "then"), keys, step, ["then"], "left")
        jumps = written(further.select(*keys, "stretch", F.transform("exits", lambda x: F.coalesce(F.get("then", x), F.lit(0))).alias("exits")), "exits")
        step *= 2
    entries = entries.select(task.alias("task"), *(F.col(c).alias(c) for c in entries.columns))
    made = placed.groupBy("task").cogroup(entries.groupBy("task")).applyInArrow(cut, f"{types}, stretch long, batch long, first long, files int, bytes long")
    if not last:
        return made.select(*keys, "batch", "first", "files", "bytes")
    made = written(made, "batches")
    counts = made.where("stretch >= 0").groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return beside_of(made, before, keys, 0, ["before"]).select(*keys, (F.col("batch") + F.col("before")).alias("batch"), "first", "files", "bytes")


def beside_of(rows: DataFrame, others: DataFrame, keys: list[str], step: int, wanted: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the ``wanted`` columns of the row ``step`` stretches on in the same folder."""
    there = others.select(*(F.col(k).alias(f"_{k}") for k in [*keys, "stretch"]), *wanted)
    same = [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("stretch") + step == F.col("_stretch")]
    return rows.join(there, same, how).select(*rows.columns, *(wanted if how != "left_semi" else []))
