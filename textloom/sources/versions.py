"""Tables that are edited by copy on write, in any folder that Spark can write to.

Rows lie in folders by edit, ``data/commit=<id>``, with their partition key as a column by which its files are dealt and sorted: the number of files grows
with the rows' bytes, not with the number of keys, and a reader of few keys skips what the files' statistics rule out. A version is a manifest, a small table that names for
each key the edit whose rows count, and a version file that names the manifest. An edit rewrites only the
partitions that it touches, carries the others over in the manifest, and is seen when its version file appears. That is one rename,
which fails where the file exists, so of two edits of the same version one is refused, and whoever reads sees the version before or the one after.
Versions stay readable, so a snapshot is a name for one and copies nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEY = "version_key"
#: Up to so many partitions an edit names those it reads, so that others are skipped; beyond it they are joined.
NAMED = 10_000
#: How edits' names begin. Those of earlier releases, which have a folder for each key below the edit's, begin otherwise and are read as they are.
SORTED = "s"


class Overtaken(RuntimeError):
    """Another edit of the same version was there first."""


def span_key(name: str = "project", number: str = "idx", rows: int = 100_000) -> Column:
    """A project's rows in spans of ``rows`` numbers, so that an edit of one row rewrites no more than that; a project is named by a hash, which
    is short and fit for a path whatever its name."""
    span = F.floor(F.coalesce(F.col(number).cast("long"), F.lit(0)) / rows).cast("string")
    return F.concat(F.substring(F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("")), 256), 1, 16), F.lit("."), span)


class VersionedTable:
    """The table in ``root``; ``key`` says from a row's columns which partition it lies in."""

    def __init__(self, spark: SparkSession, root: str, key: Column):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, content: dict) -> None:
        """Writes a small file under a name of its own and renames it, unless the name is taken."""
        fresh, final = self._path(f".{uuid.uuid4().hex}"), self._path(name)
        out = self._store().create(fresh)
        out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        self._store().mkdirs(final.getParent())
        try:
            hadoop.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, final, none)
        except Exception as error:
            self._store().delete(fresh, False)
            if "FileAlreadyExists" in str(error):
                raise Overtaken(f"{final} is there already") from None
            raise

    def _get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    # Versions

    def version(self) -> int:
        """The latest; 0 for a table that is not there."""
        if not self._store().exists(self._path("versions")):
            return 0
        names = [f.getPath().getName() for f in self._store().listStatus(self._path("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _known(self, version: int | str | None) -> dict:
        if isinstance(version, str):
            version = self._get(f"names/{version}.json")["version"]
        return self._get(f"versions/{self.version() if version is None else version:08d}.json")

    def folders(self, version: int | str | None = None) -> DataFrame:
        """(version_key, commit): which edit's rows are each partition's."""
        return self.spark.read.schema(f"{KEY} string, commit string").parquet(f"{self.root}/{self._known(version)['manifest']}")

    def read(self, version: int | str | None = None) -> DataFrame:
        """All rows of a version, by its number or name; else of the latest."""
        return self._rows(self.folders(version), self._known(version)).drop(KEY, "commit")

    def _rows(self, folders: DataFrame, known: dict) -> DataFrame:
        schema = StructType.fromJson(known["schema"])
        kept = StructType([*schema.fields, StructField("commit", StringType()), StructField(KEY, StringType())])
        edits = [r[0] for r in folders.select("commit").distinct().collect()]  # as many as there were edits, not rows or partitions
        if not edits:
            return self.spark.createDataFrame([], kept)
        read = lambda own: self.spark.read.schema(kept).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/commit={e}" for e in sorted(own)))
        rows = reduce(DataFrame.unionByName, [read(own) for own in ([e for e in edits if e.startswith(SORTED)], [e for e in edits if not e.startswith(SORTED)]) if own])
        return rows.join(folders, ["commit", KEY], "left_semi").select(*kept.names)

    def _write(self, rows: DataFrame, base: int, stay: DataFrame | None, note: str) -> int:
        commit = SORTED + uuid.uuid4().hex
        kept = rows.withColumn(KEY, self.key)
        kept.hint("rebalance", F.col(KEY)).sortWithinPartitions(KEY).write.parquet(f"{self.root}/data/commit={commit}")
        written = self.spark.read.schema(kept.schema).parquet(f"{self.root}/data/commit={commit}").select(KEY).distinct().withColumn("commit", F.lit(commit))
        if stay is not None:
            moved = written.join(stay, KEY, "left_semi").limit(1).collect()
            if moved:
                raise ValueError(f"an edit made rows for the partition {moved[0][0]}, which it did not touch")
            written = stay.unionByName(written)
        manifest = f"manifests/{commit}"
        written.select(KEY, "commit").coalesce(8).write.parquet(f"{self.root}/{manifest}")
        self.switch(base, {"version": base + 1, "manifest": manifest, "schema": rows.schema.jsonValue(), "note": note})
        return base + 1

    def switch(self, base: int, content: dict) -> None:
        """Makes what was written beside ``base`` the next version, if there is none yet."""
        self._put(f"versions/{base + 1:08d}.json", content)

    def replace(self, rows: DataFrame, note: str = "", base: int | None = None) -> int:
        """A new version of these rows alone."""
        return self._write(rows, self.version() if base is None else base, None, note)

    def edit(self, change: Callable[[DataFrame], DataFrame], touched: DataFrame, note: str = "", base: int | None = None) -> int:
        """A new version in which the partitions of the rows ``touched`` (any rows with the key's columns) are what ``change`` makes of
        theirs. A partition that is left without rows goes; rows for a partition that was not touched are an error."""
        base = self.version() if base is None else base
        known, folders = self._known(base), self.folders(base)
        keys = touched.select(self.key.alias(KEY)).distinct()
        hit = folders.join(keys, KEY, "left_semi")
        rows, named = self._rows(hit, known), [r[0] for r in hit.select(KEY).limit(NAMED + 1).collect()]
        rows = (rows.where(F.col(KEY).isin(named)) if len(named) <= NAMED else rows).drop(KEY, "commit")
        return self._write(change(rows), base, folders.join(keys, KEY, "left_anti"), note)

    def name(self, name: str, version: int | None = None) -> None:
        """A lasting name for a version: a snapshot. A name that is taken is refused."""
        self._put(f"names/{name}.json", {"version": self.version() if version is None else version})

    def unnamed(self, keep: int = 10) -> list[str]:
        """Edits that none of the latest ``keep`` versions and no named one refers to. A plan: nothing is deleted."""
        last, names = self.version(), self._path("names")
        wanted = {*range(max(1, last - keep + 1), last + 1)}
        if self._store().exists(names):
            wanted |= {self._get(f"names/{f.getPath().getName()}")["version"] for f in self._store().listStatus(names) if not f.getPath().getName().startswith(".")}
        used = {r[0] for v in wanted for r in self.folders(v).select("commit").distinct().collect()}
        there = [f.getPath().getName().removeprefix("commit=") for f in self._store().listStatus(self._path("data"))]
        return sorted(set(there) - used)
