"""A library folder as a Spark data source: ``spark.read.format("library").load(folder)``.

A library has a folder for each project with ``meta.json`` and the chapters in ``chapters`` (Parquet files). A folder without
both is no project. Each project is a partition, and filters on ``project`` and ``idx`` are taken over: other projects are not opened, and row groups
outside a range of numbers are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from textloom.operators.chapters import SCHEMA

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
ARROW = pa.schema([(c, KINDS[kind]) for c, (kind, _) in SCHEMA.items()])


class Project(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class Library(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {kind}" for c, (kind, _) in SCHEMA.items())

    def reader(self, schema: StructType) -> LibraryReader:
        return LibraryReader(self.options["path"])


class LibraryReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder if "://" in folder else f"file://{folder}"
        self.names: set[str] | None = None
        self.lo: int | None = None
        self.hi: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "project" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif column == "idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.lo = max(f.value + isinstance(f, GreaterThan), f.value if self.lo is None else self.lo)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.hi = min(f.value - isinstance(f, LessThan), f.value if self.hi is None else self.hi)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        there = [x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory]
        wanted = sorted(n for n in there if self.names is None or n in self.names)
        whole = lambda n: all(x.type != fs.FileType.NotFound for x in store.get_file_info([f"{root}/{n}/meta.json", f"{root}/{n}/chapters"]))
        return [Project(n) for n in wanted if whole(n)] or [Project("")]

    def read(self, partition: Project) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = fs.FileSystem.from_uri(self.folder)
        rows = ds.dataset(f"{root}/{partition.name}/chapters", filesystem=store, format="parquet")
        within = [x for x in (None if self.lo is None else ds.field("idx") >= self.lo, None if self.hi is None else ds.field("idx") <= self.hi) if x is not None]
        have = [c for c in SCHEMA if c in rows.schema.names and c != "project"]
        for batch in rows.to_batches(columns=have, filter=within[0] & within[-1] if within else None):
            n = batch.num_rows
            if n:
                # A project's name is its folder's; columns that a file lacks have their defaults, and so have nulls.
                columns = [pa.array([partition.name] * n) if c == "project" else batch.column(c).cast(KINDS[kind]).fill_null(default) if c in have else pa.array([default] * n, KINDS[kind]) for c, (kind, default) in SCHEMA.items()]
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets it take filters over."""
    spark.dataSource.register(Library)
    spark.conf.set(PUSHDOWN, "true")


def write_library(rows, folder: str, part_rows: int = 200_000) -> None:
    """Writes chapters (with a project that is fit for a folder's name) and a ``meta.json`` for each project to a new library folder. Rows are dealt by ranges of
    project and number, so a large project is several files and no task holds it whole."""
    from pyspark.sql import functions as F

    from textloom.sources.sidecars import write_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        attempt, out, last, n = TaskContext.get().taskAttemptId(), None, None, 0
        for batch in batches:
            names = batch.column("project").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != last:
                    if out:
                        out.close()
                    last = names[a]
                    if not last or "/" in last or last.startswith("."):
                        raise ValueError(f"not a name for a project's folder: {last!r}")
                    store.create_dir(f"{root}/{last}/chapters", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{last}/chapters/part-{attempt}.parquet", ARROW, filesystem=store)
                out.write_batch(batch.slice(a, b - a).cast(ARROW))
                n += b - a
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["rows"])

    parts = max(1, -(-rows.count() // part_rows))
    ordered = rows.select(*SCHEMA).repartitionByRange(parts, "project", "idx").sortWithinPartitions("project", "idx")
    ordered.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
    metas = rows.select("project").distinct().select(F.concat("project", F.lit("/meta.json")).alias("name"), F.to_json(F.struct(F.col("project").alias("title"))).alias("text"))
    write_texts(metas, folder).agg(F.sum("bytes")).collect()
