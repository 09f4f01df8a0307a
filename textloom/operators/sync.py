"""Incremental synchronisation and retention, as plans: nothing is ever sent or deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.lines import folded
from textloom.functions.text import file_number, part_range
from textloom.operators.batching import batched
from textloom.operators.intervals import merged, within
from textloom.operators.numbering import numbered

TOLERANCE_S = 2.0
AUDIO = (".mp3", ".wav")
CUES = ".cues.json"


def plan_uploads(items: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """``items`` (relpath, size, mtime) with ``send``: whether the manifest (relpath, size, mtime text, status)
    does not vouch for the file as it is. Whatever is doubtful is sent."""
    if force:
        return items.withColumn("send", F.lit(True))
    known = manifest.select("relpath", F.col("size").alias("m_size"), F.col("mtime").try_cast("double").alias("m_mtime"), F.col("status").alias("m_status"))
    same = (F.col("m_status") == "done") & (F.col("m_size") == F.col("size")) & (F.col("mtime") <= F.col("m_mtime") + TOLERANCE_S)
    return items.join(known, "relpath", "left").select(*items.columns, (~F.coalesce(same, F.lit(False))).alias("send"))


def batches(items: DataFrame, keys: list[str], order: list[str], max_files: int = 20, max_bytes: int = 4 << 30) -> DataFrame:
    """(keys, batch, files, bytes): greedy batches in order that never span folders and keep both bounds; a file over
    the bound is a batch of its own."""
    return batched(items, keys, order, max_files, max_bytes).select(*keys, F.col("batch").cast("int").alias("batch"), "files", "bytes")


def first_seen(items: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """(folder, place, files, bytes): folders in the order in which their first file stands among all, from 0."""
    placed = numbered(items, [], order).withColumnRenamed("pos", "_pos")
    seen = placed.groupBy(folder).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return numbered(seen, [], ["_first"]).select(folder, F.col("pos").alias("place"), "files", "bytes")


def to_send(items: DataFrame, manifest: DataFrame, project: str = "project", force: bool = False) -> DataFrame:
    """(project, files, bytes): by project, what its manifest (project, relpath, size, mtime, status) does not vouch for; projects with nothing to
    send have zeros."""
    key = F.concat(F.col(project), F.lit("\0"), F.col("relpath"))
    planned = plan_uploads(items.withColumn("_path", F.col("relpath")).withColumn("relpath", key), manifest.withColumn("relpath", key), force)
    return planned.groupBy(project).agg(F.count_if("send").alias("files"), F.coalesce(F.sum(F.when(F.col("send"), F.col("size"))), F.lit(0).cast("long")).alias("bytes"))


def landed(expected: DataFrame, remote: DataFrame) -> DataFrame:
    """Expected files (name, size) that are absent or present at another size: names are compared without
    regard to case and outer blanks, 12 % and a byte are tolerated, and a size that cannot be read counts as right."""
    there = remote.select(folded(F.col("name")).alias("_name"), F.col("size").alias("r_size"), F.lit(True).alias("there"))
    fits = F.col("r_size").isNull() | F.when(F.col("size") == 0, F.col("r_size") == 0).otherwise(F.abs(F.col("r_size") - F.col("size")) <= F.greatest(F.col("size") * 0.12, F.lit(1.0)))
    return expected.withColumn("_name", folded(F.col("name"))).join(there, "_name", "left").where(F.col("there").isNull() | ~fits).select(*expected.columns)


def safe_to_delete(local: Column, remote: Column) -> Column:
    """Whether a copy of the remote size vouches for a local file: within 1 %; an unknown size or nothing refuses."""
    return F.coalesce((local > 0) & (remote > 0) & (F.abs(remote - local) <= local * 0.01), F.lit(False))


def spans(parts: DataFrame, with_subtitles: bool = False) -> DataFrame:
    """(project, lo, hi) of rendered parts, from files (project, folder, name)."""
    suffix = lambda s: F.bool_or(F.endswith("name", F.lit(s)))
    kept = parts.groupBy("project", "folder").agg(suffix(".mp4").alias("video"), suffix(".srt").alias("subtitles")).where("video")
    kept = kept.where("subtitles") if with_subtitles else kept
    return kept.select("project", part_range(F.col("folder")).alias("span")).where("span IS NOT NULL").select("project", "span.lo", "span.hi")


def covered(parts: DataFrame, with_subtitles: bool = False) -> DataFrame:
    """(project, number) of the chapters in rendered parts: a row for each number."""
    return merged(spans(parts, with_subtitles), ["project"]).select("project", F.explode(F.sequence("lo", "hi")).alias("number"))


def retention_plan(audio: DataFrame, parts: DataFrame) -> DataFrame:
    """Audio files (project, name, size) that a rendered part holds, with the reason; cue files need a part with
    subtitles as well."""
    numbered, name = audio.withColumn("number", file_number(F.col("name"))), F.lower("name")
    sound = numbered.where(F.endswith(name, F.lit(AUDIO[0])) | F.endswith(name, F.lit(AUDIO[1])))
    cues = numbered.where(F.endswith(name, F.lit(CUES)))
    one = within(sound, spans(parts), ["project"], "number").withColumn("reason", F.lit("in a rendered part"))
    two = within(cues, spans(parts, True), ["project"], "number").withColumn("reason", F.lit("in a part with subtitles"))
    return one.unionByName(two)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rows.columns if c not in (*keys, *order)))).alias("_r")).select(*keys, "_r.*")


def upload_state(raw: Column) -> Column:
    """The status in a state document: missing is empty, unreadable is ``unknown``, never empty."""
    parsed = F.try_parse_json(raw)
    return F.when(raw.isNull() | (raw == ""), "").when(parsed.isNull(), "unknown").otherwise(F.coalesce(F.try_variant_get(parsed, "$.status", "string"), F.lit("")))


# The states of an upload that nobody but a person may settle.
UNRESOLVED = ("started", "draft", "committed", "unknown")


def lifecycle(raw: Column) -> Column:
    """struct(status, video_id, published, unresolved, draft, uploadable) of a state document."""
    status = upload_state(raw)
    video_id = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.video_id", "string"), F.lit(""))
    empty = F.coalesce(F.regexp_like(raw, F.lit(r"^\s*(\{\s*\}\s*)?$")), F.lit(True))
    return F.struct(
        status.alias("status"), video_id.alias("video_id"), (status == "published").alias("published"), status.isin(*UNRESOLVED).alias("unresolved"),
        ((video_id != "") & (status != "published")).alias("draft"), empty.alias("uploadable"),
    )


def video_candidates(files: DataFrame, states: DataFrame) -> DataFrame:
    """Published videos: ``files`` (project, folder, name, size) of rendered parts with a state (project, folder, json)
    that says so. Candidates only; a look at the store must confirm each."""
    done = states.where(lifecycle(F.col("json"))["published"]).select("project", "folder")
    return files.where(F.endswith(F.lower("name"), F.lit(".mp4"))).join(done, ["project", "folder"], "left_semi")


def pending_parts(rendered: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered parts that are neither published nor left unresolved."""
    life = lifecycle(F.col("json"))
    return rendered.join(states.where(life["published"] | life["unresolved"]).select(*keys), keys, "left_anti")


def with_remote_id(rendered: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    return rendered.join(states.where(lifecycle(F.col("json"))["video_id"] != "").select(*keys), keys, "left_semi")


def claims_backed_up(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """(relpath, backed_up): whether the manifest believes it sent each file as it is now. A belief, not evidence."""
    return plan_uploads(items, manifest).select("relpath", (~F.col("send")).alias("backed_up"))


def unrendered(windows: DataFrame, rendered: DataFrame, speed: float) -> DataFrame:
    """By project, of the windows (project, first, last, chapters, seconds) without a rendered part (project, first, last): how
    many, their chapters and seconds, and the hours that rendering takes."""
    left = windows.join(rendered, ["project", "first", "last"], "left_anti")
    return left.groupBy("project").agg(F.count(F.lit(1)).alias("parts"), F.sum("chapters").alias("chapters"), F.sum("seconds").alias("seconds"), (F.sum("seconds") / 3600 / speed).alias("hours"))


def state_log(kind: str, keys: DataFrame, at: Column) -> DataFrame:
    """Log rows (keys, at, fields) of a hand's marks: ``published`` without an id, or ``cleared``, a tombstone."""
    fields = {"published": F.create_map(F.lit("status"), F.lit("published"), F.lit("marked_by_hand"), F.lit("true")), "cleared": F.lit(None).cast("map<string,string>")}
    return keys.select("*", at.alias("at"), fields[kind].alias("fields"))


def state_of_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """The state that a log (keys, at, fields) adds up to; what stands before the last tombstone counts no more."""
    cleared = log.where("fields IS NULL").groupBy(*keys).agg(F.max("at").alias("cleared"))
    live = log.where("fields IS NOT NULL").join(cleared, keys, "left").where("cleared IS NULL OR at > cleared")
    each = live.select(*keys, "at", F.explode("fields").alias("field", "value")).groupBy(*keys, "field").agg(F.max_by("value", "at").alias("value"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("state"))


def remote_sizes(names: Column, sizes: Column) -> Column:
    """A map of names to sizes; where the two columns do not match, every size is unknown."""
    unknown = F.transform(names, lambda n: F.lit(None).cast("long"))
    return F.map_from_arrays(names, F.when(F.size(names) == F.size(sizes), sizes).otherwise(unknown))


def only_folders(names: Column, kinds: Column) -> Column:
    """The names whose kind beside them is a folder; none where the columns do not match."""
    picked = F.filter(F.arrays_zip(names.alias("n"), kinds.alias("k")), lambda z: F.lower(F.trim(z["k"])) == "folder")
    return F.when(F.size(names) == F.size(kinds), F.transform(picked, lambda z: z["n"])).otherwise(F.array().cast("array<string>"))


def restamped(rendered: DataFrame, tags: DataFrame, suffix: str = ".tags.txt") -> DataFrame:
    """(name, text) of the side files of rendered parts (project, folder) that are to be written again because their project's tags (project, tags) changed; blank
    tags change nothing."""
    known = rendered.join(tags.where(F.trim("tags") != ""), "project")
    return known.select(F.concat("project", F.lit("/"), "folder", F.lit("/"), "folder", F.lit(suffix)).alias("name"), F.concat("tags", F.lit("\n")).alias("text"))


def settings_of(chosen: DataFrame, defaults: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys, settings) of a run: every known setting with the value that holds when it begins, so that later changes do not reach it. ``chosen``: (keys, name, value),
    of which unknown names are dropped and nulls and blanks count as not chosen."""
    known = chosen.where(F.col("name").isin(*defaults) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    own = known.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("own"))
    default = F.create_map(*(F.lit(x) for pair in sorted(defaults.items()) for x in pair))
    every = chosen.select(*keys).distinct().join(own, keys, "left")
    return every.select(*keys, F.transform_values(default, lambda k, v: F.coalesce(F.try_element_at("own", k), v)).alias("settings"))
