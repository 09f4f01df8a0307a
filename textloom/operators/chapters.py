"""The chapter table: one row for each (project, idx), with its lifecycle predicates and updates.

Empty strings, not nulls, mean that something is absent; nulls are made empty on reading. Updates
return a new table; nothing is overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns with the value of a row that lacks them.
SCHEMA = {
    "project": ("string", ""), "idx": ("long", 0), "title": ("string", ""), "url": ("string", ""), "content": ("string", ""), "translated": ("string", ""),
    "translated_title": ("string", ""), "target_lang": ("string", ""), "translator": ("string", ""), "translate_seconds": ("double", 0.0), "status": ("string", "pending"),
    "error": ("string", ""), "updated_at": ("string", ""), "audio_path": ("string", ""), "audio_voice": ("string", ""), "audio_source": ("string", "translated"),
    "audio_seconds": ("double", 0.0), "audio_error": ("string", ""), "title_custom": ("boolean", False), "title_source": ("string", ""),
}
#: Columns that replacing may edit.
EDITABLE = ("title", "content", "translated_title", "translated")


def conformed(rows: DataFrame) -> DataFrame:
    """All columns in order: missing ones are added and nulls filled (additive schema evolution)."""
    have = set(rows.columns)
    return rows.select(*(F.coalesce(F.col(c).cast(kind), F.lit(default)).alias(c) if c in have else F.lit(default).cast(kind).alias(c) for c, (kind, default) in SCHEMA.items()))


def has(column: str) -> Column:
    return F.col(column) != ""


def pending_download(rows: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    out = rows.where(~has("content") & (F.col("idx") >= lo))
    return out if hi is None else out.where(F.col("idx") <= hi)


def in_range(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    return rows.where(F.col("idx").between(lo, hi))


def pending_translation(rows: DataFrame, lang: str) -> DataFrame:
    return rows.where(has("content") & (~has("translated") | (F.col("target_lang") != lang)))


def pending_audio(rows: DataFrame, voice: str = "", use_translation: bool = True) -> DataFrame:
    text, source = ("translated", "translated") if use_translation else ("content", "original")
    stale = ~has("audio_path") | (F.col("audio_source") != source)
    return rows.where(has(text) & (stale | (F.col("audio_voice") != voice) if voice else has(text) & stale))


def errored(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "error")


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """All lifecycle counts in one pass."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has("content")).alias("downloaded"), F.count_if(has("translated")).alias("translated"),
        F.count_if(has("audio_path")).alias("voiced"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def text_choice(rows: DataFrame, use_translation: bool) -> DataFrame:
    """title and body for export; both null where that text is missing."""
    if use_translation:
        title, body = F.when(has("translated_title"), F.col("translated_title")).otherwise(F.col("title")), F.col("translated")
    else:
        title, body = F.col("title"), F.col("content")
    return rows.select("project", "idx", F.when(body != "", title).alias("title"), F.when(body != "", body).alias("body"))


def updated(rows: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("project", "idx"), **rules: Column) -> DataFrame:
    """Rows with ``rules`` applied where ``changes`` has a row of the same key; a rule may use the
    columns of ``changes`` under the prefix new_."""
    new = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys), F.lit(True).alias("hit"))
    joined = rows.join(new, list(keys), "left")
    return joined.select(*(F.when(F.col("hit"), rules[c]).otherwise(F.col(c)).alias(c) if c in rules else F.col(c) for c in rows.columns))


def replace_toc(rows: DataFrame, refs: DataFrame, now: str) -> DataFrame:
    """Upserts a table of contents (project, idx, title, url): known rows get the new url and title source, and the
    new title unless theirs is custom; new rows are pending; rows that the contents lack stay."""
    new = refs.select("project", "idx", F.col("title").alias("new_title"), F.col("url").alias("new_url"))
    both = rows.withColumn("old", F.lit(True)).join(new, ["project", "idx"], "full_outer")
    hit, fresh = F.col("new_url").isNotNull(), F.col("old").isNull()
    title = F.when(hit & (fresh | ~F.col("title_custom")), F.col("new_title")).otherwise(F.col("title"))
    source = F.when(fresh, F.lit("")).when(hit, F.col("new_title")).otherwise(F.col("title_source"))
    rules = {"title": title, "url": F.coalesce("new_url", "url"), "title_source": source, "updated_at": F.when(fresh, F.lit(now)).otherwise(F.col("updated_at"))}
    return both.select(*(rules[c].alias(c) if c in rules else F.coalesce(F.col(c), F.lit(SCHEMA[c][1])).alias(c) for c in rows.columns))


def append_rows(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(project, idx, title) of new rows after each project's largest idx, from (project, pos, title);
    blank titles are dropped."""
    from textloom.operators.numbering import numbered

    top = rows.groupBy("project").agg(F.max("idx").alias("top"))
    named = numbered(titles.select("project", F.col("pos").alias("_place"), F.trim("title").alias("title")).where("title <> ''"), ["project"], ["_place"])
    return named.join(top, "project", "left").select("project", (F.coalesce("top", F.lit(-1)) + F.col("pos") + 1).cast("long").alias("idx"), "title")


def save_content(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return updated(rows, texts, content=F.col("new_content"), status=F.lit("downloaded"), error=F.lit(""))


def save_translation(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return updated(rows, texts, translated=F.col("new_translated"), target_lang=F.col("new_target_lang"), status=F.lit("translated"), error=F.lit(""))


def edit_content(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """A text that is filled in lifts pending and errored rows to downloaded; no status falls."""
    lifted = F.when((F.col("new_content") != "") & F.col("status").isin("pending", "error"), F.lit("downloaded")).otherwise(F.col("status"))
    return updated(rows, texts, content=F.col("new_content"), status=lifted)


def mark_error(rows: DataFrame, errors: DataFrame) -> DataFrame:
    return updated(rows, errors, status=F.lit("error"), error=F.col("new_error"))


def rederived(rows: DataFrame, which: Column, **blank: Column) -> DataFrame:
    """Rows that match ``which`` with their status as their content says (after clearing or a reset)."""
    status = F.when(F.col("content") == "", F.lit("pending")).otherwise(F.lit("downloaded"))
    rules = {"status": status, **blank}
    return rows.select(*(F.when(which, rules[c]).otherwise(F.col(c)).alias(c) if c in rules else F.col(c) for c in rows.columns))


def clear_translations(rows: DataFrame) -> DataFrame:
    return rederived(rows, F.col("translated") != "", translated=F.lit(""), translated_title=F.lit(""), target_lang=F.lit(""))


def reset_errors(rows: DataFrame) -> DataFrame:
    return rederived(rows, F.col("status") == "error", error=F.lit(""))


def edit_title(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """A renamed row is custom and remembers the title it had from its source."""
    source = F.when(F.col("title_custom"), F.col("title_source")).otherwise(F.col("title"))
    return updated(rows, titles, title=F.col("new_title"), title_source=source, title_custom=F.lit(True))


def reset_title(rows: DataFrame, which: DataFrame) -> DataFrame:
    title = F.when(F.col("title_source") != "", F.col("title_source")).otherwise(F.col("title"))
    return updated(rows, which, title=title, title_custom=F.lit(False))


def find(rows: DataFrame, search: str, fields: tuple[str, ...] = EDITABLE, new: str = "", ignore_case: bool = False) -> DataFrame:
    """(project, idx, changes): for rows with a match, the old and new value and count of each field."""
    from textloom.functions.text import literal_count, literal_replace

    unknown = set(fields) - set(EDITABLE)
    if unknown:
        raise ValueError(f"not editable: {sorted(unknown)}")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("old"), literal_replace(F.col(c), search, new, ignore_case).alias("new"), literal_count(F.col(c), search, ignore_case).alias("n")) for c in fields))
    return rows.select("project", "idx", F.filter(each, lambda x: x["n"] > 0).alias("changes")).where(F.size("changes") > 0)


def apply_changes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Writes the very values that ``find`` showed."""
    value = lambda c: F.get(F.filter("new_changes", lambda x: x["field"] == c), F.lit(0))["new"]
    return updated(rows, found, **{c: F.coalesce(value(c), F.col(c)) for c in EDITABLE})


def delete_row(rows: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the rows of ``which`` (project, idx), and those rows; numbers of the others stay, gaps too."""
    keys = ["project", "idx"]
    return rows.join(which.select(*keys), keys, "left_anti"), rows.join(which.select(*keys), keys, "left_semi")


def edit_translation(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Writes the fields of ``edits`` (translated_title, translated) that are not null; engine, language and status stay."""
    given = [c for c in ("translated_title", "translated") if c in edits.columns]
    return updated(rows, edits.select("project", "idx", *given), **{c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in given})


def save_audio(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``made``: audio_path, audio_voice, audio_seconds and, or else ``translated``, audio_source; an earlier error is cleared."""
    source = F.coalesce("new_audio_source", F.lit("translated")) if "audio_source" in made.columns else F.lit("translated")
    return updated(rows, made, audio_path=F.col("new_audio_path"), audio_voice=F.col("new_audio_voice"), audio_seconds=F.col("new_audio_seconds"), audio_source=source, audio_error=F.lit(""))


def mark_audio_error(rows: DataFrame, errors: DataFrame) -> DataFrame:
    return updated(rows, errors, audio_error=F.col("new_audio_error"))


def clear_audio(rows: DataFrame) -> DataFrame:
    blank = {"audio_path": F.lit(""), "audio_voice": F.lit(""), "audio_seconds": F.lit(0.0), "audio_error": F.lit("")}
    return rows.select(*(blank[c].alias(c) if c in blank else F.col(c) for c in rows.columns))


def identity_fill(rows: DataFrame, lang: str) -> DataFrame:
    """Where source and target language are one, the text is its own translation."""
    fill = {"translated": F.col("content"), "translated_title": F.col("title"), "target_lang": F.lit(lang), "translator": F.lit("identity"), "status": F.lit("translated"), "error": F.lit("")}
    due = has("content") & (~has("translated") | (F.col("target_lang") != lang))
    return rows.select(*(F.when(due, fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in rows.columns))


def land_translated(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that arrive translated (content, translator, target_lang) are content and translation at once."""
    both = {"content": F.col("new_content"), "translated": F.col("new_content"), "translator": F.col("new_translator"), "target_lang": F.col("new_target_lang"), "status": F.lit("translated"), "error": F.lit("")}
    return updated(rows, texts, **both)


def replaced(rows: DataFrame, search: str, new: str, fields: tuple[str, ...] = EDITABLE, ignore_case: bool = False) -> DataFrame:
    """What applying all of ``find``'s changes gives, in one pass without a join."""
    from textloom.functions.text import literal_replace

    return rows.select(*(literal_replace(F.col(c), search, new, ignore_case).alias(c) if c in fields else F.col(c) for c in rows.columns))


def voiced_files(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose audio file is in a listing (project, relpath)."""
    return rows.join(listing.select("project", F.col("relpath").alias("audio_path")), ["project", "audio_path"], "left_semi").select(*rows.columns)


def shown_status(use_translation: bool) -> Column:
    """What a list shows of a row's voice: no text yet, an error, made, or not made."""
    text, missing = (has("translated"), "not translated") if use_translation else (has("content"), "not fetched")
    return F.when(~text, missing).when(has("audio_error"), "error").when(has("audio_path"), "made").otherwise("not made")


def regenerable(rows: DataFrame, chosen: DataFrame, use_translation: bool) -> tuple[DataFrame, DataFrame]:
    """The chosen rows (project, idx) that have the text, each once and in order; and by project how many have not."""
    keys = ["project", "idx"]
    picked = rows.join(chosen.select(*keys).distinct(), keys, "left_semi")
    text = has("translated") if use_translation else has("content")
    return picked.where(text).select(*keys).orderBy(*keys), picked.groupBy("project").agg(F.count_if(~text).alias("dropped"))


def first_missing(rows: DataFrame, missing: Column, most: int) -> DataFrame:
    """(project, included, skipped, first): counts, and the first few missing idx; no more than these are gathered."""
    from pyspark.sql import Window

    counted = rows.groupBy("project").agg(F.count_if(~missing).alias("included"), F.count_if(missing).alias("skipped"))
    ranked = rows.where(missing).select("project", "idx", F.row_number().over(Window.partitionBy("project").orderBy("idx")).alias("k")).where(F.col("k") <= most)
    first = ranked.groupBy("project").agg(F.array_sort(F.collect_list("idx")).alias("first"))
    return counted.join(first, "project", "left").withColumn("first", F.coalesce("first", F.array().cast("array<long>")))
