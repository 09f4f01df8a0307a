"""Side files of a project: cue files, manifests, state files and listings, read leniently and in parallel."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.versions import VersionedTable

CUES = "version int, seconds double, cues array<array<string>>"
MANIFEST = "version int, remote_root string, account string, updated_at string, files map<string,struct<size:bigint,mtime:string,status:string,uploaded_at:string>>"
META = "url string, site string, title string, author string, description string, cover_url string, source_lang string, translated_title string, translated_description string, translated_author string, translated_lang string, tags string, display_title string, upload_visibility string, video_settings map<string,string>"  # noqa: E501


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """(relpath, size, mtime) of all files below a folder, empty ones too (which Spark's file sources pass over); contents are not read. The folder itself
    is listed by the driver, what lies in its folders by tasks."""
    store, base = fs.FileSystem.from_uri(folder)
    top = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = [(x.base_name, x.type == fs.FileType.Directory, x.size, x.mtime_ns) for x in top]
    rows = spark.createDataFrame(names, "name string, inside boolean, size long, mtime long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if row["inside"]:
                    found = [(x.path[len(base.rstrip("/")) + 1 :], x.size, x.mtime_ns) for x in store.get_file_info(fs.FileSelector(f"{base}/{row['name']}", recursive=True)) if x.type == fs.FileType.File]
                else:
                    found = [(row["name"], row["size"], row["mtime"])]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([(f[2] or 0) / 1e9 for f in found], pa.float64())], names=["relpath", "size", "mtime"])

    return rows.repartition(min(max(1, len(names)), 1000)).mapInArrow(run, "relpath string, size long, mtime double")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(relpath, size, mtime) below a folder without hidden, temporary and journal files; contents are not read."""
    return files_below(spark, folder).where(~F.regexp_like("relpath", F.lit(r"(^|/)\.|\.tmp$|-wal$|-shm$")))


def parsed_cues(raw: DataFrame) -> DataFrame:
    """(key, start, end, text) from (key, json): cue rows that are not a triple of two numbers and a text are dropped, and a file that
    cannot be read has no cues."""
    cue = F.explode(F.from_json("json", CUES)["cues"]).alias("cue")
    rows = raw.select("key", cue).where(F.size("cue") == 3)
    typed = rows.select("key", F.get("cue", F.lit(0)).try_cast("double").alias("start"), F.get("cue", F.lit(1)).try_cast("double").alias("end"), F.get("cue", F.lit(2)).alias("text"))
    return typed.where("start IS NOT NULL AND end IS NOT NULL")


def cue_json(cues: DataFrame) -> DataFrame:
    """(key, json) of cue files from (key, start, end, text, seconds), with times rounded to the millisecond."""
    each = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    rows = cues.groupBy("key").agg(each.alias("cues"), F.max("seconds").alias("seconds"))
    triple = lambda c: F.concat(F.lit("["), F.bround(c["start"], 3).cast("string"), F.lit(","), F.bround(c["end"], 3).cast("string"), F.lit(","), F.regexp_extract(F.to_json(F.struct(c["text"].alias("t"))), r'^\{"t":(.*)\}$', 1), F.lit("]"))
    return rows.select("key", F.concat(F.lit('{"version":1,"seconds":'), F.bround("seconds", 3).cast("string"), F.lit(',"cues":['), F.array_join(F.transform("cues", triple), ","), F.lit("]}")).alias("json"))


def parsed_manifest(raw: DataFrame) -> DataFrame:
    """(key, relpath, size, mtime, status) from (key, json): a manifest that is missing or broken is empty."""
    files = F.from_json("json", MANIFEST)["files"]
    rows = raw.select("key", F.explode(files).alias("relpath", "record")).where("record IS NOT NULL")
    return rows.select("key", "relpath", "record.size", "record.mtime", "record.status")


def manifest_notes(raw: DataFrame) -> DataFrame:
    """(key, note) from (key, json): empty for a sound manifest, else ``missing`` or ``corrupt``; either is read as empty."""
    files = F.from_json("json", MANIFEST)["files"]
    return raw.select("key", F.when(F.col("json").isNull(), "missing").when(files.isNull(), "corrupt").otherwise("").alias("note"))


def manifest_json(records: DataFrame) -> DataFrame:
    """(key, json) of manifests from (key, remote_root, account, updated_at, relpath, size, mtime, status, uploaded_at)."""
    entry = F.struct("relpath", F.struct("size", "mtime", "status", "uploaded_at").alias("record"))
    rows = records.groupBy("key", "remote_root", "account", "updated_at").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))
    return rows.select("key", F.to_json(F.struct(F.lit(1).alias("version"), "remote_root", "account", "updated_at", "files")).alias("json"))


def whole_table(spark: SparkSession, path: str) -> VersionedTable:
    """A table that is always replaced as a whole."""
    return VersionedTable(spark, path, F.lit("all"))


def replace_table(df: DataFrame, path: str) -> int:
    """Writes a table beside the one at ``path`` and switches to it by one rename: readers find the old one or the new one, whole, and a
    writer that dies before the switch leaves the old one. Of two writers at once one is refused."""
    return whole_table(df.sparkSession, path).replace(df)


def current_table(spark: SparkSession, path: str, version: int | str | None = None) -> DataFrame:
    """The table at ``path`` as it is now, or as it was in a version or snapshot."""
    return whole_table(spark, path).read(version)


def snapshot(spark: SparkSession, path: str, name: str) -> None:
    """A lasting name for the table as it is now; it copies nothing, and a name that is taken is refused."""
    whole_table(spark, path).name(name)


def parsed_meta(raw: DataFrame) -> DataFrame:
    """Known fields of (key, json); unknown ones are ignored, and nulls are empty."""
    meta = F.from_json("json", META)
    names = [x.split()[0] for x in META.split(", ")]
    return raw.select("key", *(F.coalesce(meta[n], F.lit("")).alias(n) if n != "video_settings" else meta[n].alias(n) for n in names))


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """One file for each row (name, text) of ``rows``, under its name in ``folder``: (name, bytes). Each is written under a name of its own
    and renamed when it is whole. A name may have folders; one that leads out of ``folder`` is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name for a file: {name!r}")
                raw, final = (text or "").encode("utf-8", "surrogatepass"), f"{base}/{name}"
                store.create_dir(final.rpartition("/")[0], recursive=True)
                part = f"{final.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(raw)
                store.move(part, final)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "text").mapInArrow(run, "name string, bytes long")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of all files below a folder, names relative to it; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("relpath").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read().decode("utf-8", "replace")])], names=["name", "text"])

    return files_below(spark, folder).select("relpath").mapInArrow(run, "name string, text string")
