"""Timelines: grid windows, running offsets, timestamps and subtitle documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    """Whole milliseconds, half to even, no less than 0."""
    return F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")


def part_number(first: Column, batch: int) -> Column:
    """The slot, counted from 1, of a grid of ``batch`` numbers that starts at 1; 1 without a grid."""
    return F.floor((first - 1) / batch).cast("int") + 1 if batch >= 1 else F.lit(1)


def merge_windows(rows: DataFrame, keys: list[str], mode: str = "all", start: int | None = None, end: int | None = None, batch: int | None = None) -> DataFrame:
    """part, first, last and size of the windows of (keys, idx): ``all`` rows, those of a ``range`` of numbers, or a grid of
    ``batch`` numbers. Numbers count from 1; grid bounds depend on the number alone, so gaps shift nothing;
    first and last are numbers that are there, and empty windows are left out."""
    number = (F.col("idx") + 1).cast("int")
    if mode == "batch" and (batch or 0) < 1:
        raise ValueError("a batch has at least one number")
    if mode not in ("all", "range", "batch"):
        raise ValueError(f"no such mode: {mode}")
    kept = rows.where(number.between(start or 1, end or 0)) if mode == "range" else rows
    part = part_number(F.col("number"), batch) if mode == "batch" else F.lit(1)
    return kept.select(*keys, number.alias("number")).groupBy(*keys, part.alias("part")).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("size"))


def grid_windows(rows: DataFrame, keys: list[str], batch: int) -> DataFrame:
    return merge_windows(rows, keys, "batch", batch=batch)


def offsets(rows: DataFrame, keys: list[str], order: list[str], ms: str = "ms") -> DataFrame:
    """start_ms and end_ms of each row from the milliseconds of those before it."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(ms).over(frame)
    return rows.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col(ms))


def clock(ms: Column, mark: str) -> Column:
    """``HH:MM:SS``, then ``mark`` and three digits."""
    h, m, s, r = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, r)


def srt_time(seconds: Column) -> Column:
    return clock(millis(seconds), ",")


def ass_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``."""
    cs = F.bround(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def short_time(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on, truncated."""
    t = seconds.cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def srt_documents(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One subtitle document for each key from (start, end, text) in seconds: blank cues are dropped and
    take no number."""
    said = cues.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).where("text <> ''")
    numbered = said.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks")).select(*keys, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("document"), F.size("blocks").alias("cues"))


def metadata_escape(value: Column) -> Column:
    for sign in ("\\", "=", ";", "#"):
        value = F.replace(value, F.lit(sign), F.lit("\\" + sign))
    return F.replace(value, F.lit("\n"), F.lit(" "))


def quoted_path(path: Column) -> Column:
    """A line of a concatenation list."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def scaled(cues: Column, factor: Column, shift: Column) -> Column:
    """Cue arrays with every start and end multiplied, then moved."""
    return F.transform(cues, lambda c: F.struct((c["start"] * factor + shift).alias("start"), (c["end"] * factor + shift).alias("end"), c["text"].alias("text")))


def hms(seconds: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` under an hour, of the nearest second, half to even."""
    return short_time(F.bround(seconds))


def compact(seconds: Column) -> Column:
    """``42s``, ``3m05s`` or ``1h02m``; empty for nothing."""
    t = F.bround(seconds).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(t <= 0, "").when(t < 60, F.format_string("%ds", t)).when(t < 3600, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%dh%02dm", h, m))


def too_long(seconds: Column, hours: int = 12) -> Column:
    return seconds > hours * 3600


def expected_gap(gap: Column, speed: Column) -> Column:
    """A pause as it is in a file that was sped up; a speed of 0 counts as 1."""
    return gap / F.coalesce(F.nullif(speed, F.lit(0.0)), F.lit(1.0))


def part_cues(segments: DataFrame, cues: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cues in the time of their part, and (keys, covered, total).

    ``segments``: (keys, pos, segment, seconds); ``cues``: (segment, start, end, text) in the segment's time. A
    segment without cues still moves those after it.
    """
    frame = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("offset", F.coalesce(F.sum("seconds").over(frame), F.lit(0.0)))
    moved = placed.join(cues, "segment").select(*keys, "pos", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "text")
    spoken = segments.join(cues.select("segment").distinct().withColumn("spoken", F.lit(1)), "segment", "left")
    return moved, spoken.groupBy(*keys).agg(F.count("spoken").alias("covered"), F.count(F.lit(1)).alias("total"))


def gap_cues(chunks: Column, gaps: Column, duration: Column) -> Column:
    """array(struct(start, end, text)): chunk i lasts from the end of the gap before it to the start of the one
    after it; null unless there is exactly one gap between each two chunks."""
    bound = lambda at, field, other: F.coalesce(F.get(gaps, at)[field], other)
    cues = F.transform(chunks, lambda text, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(bound(F.greatest(i - 1, F.lit(0)), "end", F.lit(0.0))).alias("start"), bound(i, "start", duration).alias("end"), text.alias("text")))
    return F.when((F.size(chunks) > 0) & (F.size(gaps) == F.size(chunks) - 1), cues)


def schedule(rows: DataFrame, keys: list[str], order: list[str], start: Column, days: int) -> DataFrame:
    """``rows`` with the time ``at`` of each, ``days`` after the one before it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("at", start + F.make_dt_interval(place * days))


def settled(polls: DataFrame, keys: list[str], order: str, text: str, least: int = 400) -> DataFrame:
    """Polls at which a text of over ``least`` characters has not changed over the two polls before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.lag(text, 1).over(w) == F.col(text)) & (F.lag(text, 2).over(w) == F.col(text))
    return polls.withColumn("_same", F.coalesce(same, F.lit(False))).where(F.col("_same") & (F.length(text) > least)).drop("_same")


def ass_document(events: Column, title: Column, width: int = 1920, height: int = 1080, font: str = "Arial", size: int = 54, margin: int = 60) -> Column:
    """An ASS document with header, one style and the events array(struct(start, end, text)) in seconds."""
    head = F.concat(F.lit("[Script Info]\nTitle: "), title, F.lit(f"\nScriptType: v4.00+\nPlayResX: {width}\nPlayResY: {height}\nWrapStyle: 0\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, Alignment, MarginL, MarginR, MarginV\nStyle: Default,{font},{size},&H00FFFFFF,2,40,40,{margin}\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"))  # noqa: E501
    line = lambda e: F.concat(F.lit("Dialogue: 0,"), ass_time(e["start"]), F.lit(","), ass_time(e["end"]), F.lit(",Default,,0,0,0,,"), e["text"])
    return F.concat(head, F.array_join(F.transform(events, line), "\n"), F.lit("\n"))


def description(header: Column, chapters: Column) -> Column:
    """A video's description: a header, then a line ``time title`` for each of array(struct(start, title))."""
    table = F.array_join(F.transform(chapters, lambda c: F.concat(short_time(c["start"]), F.lit(" "), c["title"])), "\n")
    return F.concat(F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise(""), table)


# The names of the three kinds of event and the fade of a chapter's title.
NOVEL, CHAPTER, SUBTITLE, FADE = "Novel", "Chapter", "Sub", r"{\fad(400,400)}"


def video_events(segments: DataFrame, cues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, events): the event lines of a part's video. ``segments`` (keys, novel, order, title, seconds) give the novel's title over all, and each chapter's
    title for its time, faded; ``cues`` (keys, start, end, text, in the part's time) are the narration, without blank ones. Titles and texts are
    escaped, the fade is not."""
    from textloom.operators.library import event_escape

    line = lambda a, b, style, text: F.concat(F.lit("Dialogue: 0,"), ass_time(a), F.lit(","), ass_time(b), F.lit(f",{style},,0,0,0,,"), text, F.lit("\n"))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.withColumn("_end", F.sum("seconds").over(upto)).withColumn("_start", F.col("_end") - F.col("seconds"))
    whole = segments.groupBy(*keys).agg(F.max("novel").alias("novel"), F.sum("seconds").alias("total"))
    kinds = [
        whole.select(*keys, F.lit(0).alias("kind"), F.lit(0.0).alias("at"), line(F.lit(0.0), F.col("total"), NOVEL, event_escape(F.col("novel"))).alias("line")),
        placed.select(*keys, F.lit(1).alias("kind"), F.col("_start").alias("at"), line(F.col("_start"), F.col("_end"), CHAPTER, F.concat(F.lit(FADE), event_escape(F.col("title")))).alias("line")),
        cues.where(F.trim("text") != "").select(*keys, F.lit(2).alias("kind"), F.col("start").alias("at"), line(F.col("start"), F.col("end"), SUBTITLE, event_escape(F.trim("text"))).alias("line")),
    ]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "line"))), lambda x: x["line"]), "").alias("events"))
