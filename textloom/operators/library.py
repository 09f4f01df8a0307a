"""Projects, their metadata and their logs: keys, refreshes, routing of records and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import slug

#: The fields that a new scan may write; all others are the library's own work.
SCRAPED = ("site", "title", "author", "description", "cover_url", "source_lang")


def project_key(title: Column, url: Column) -> Column:
    """A folder name: the title's slug and eight digits of the address's SHA-1."""
    return F.concat(slug(title), F.lit("-"), F.substring(F.sha1(url), 1, 8))


def refreshed(old: DataFrame, scanned: DataFrame, key: str = "url") -> DataFrame:
    """``old`` with the scraped fields of rows that were scanned again."""
    have = [c for c in SCRAPED if c in old.columns and c in scanned.columns]
    new = scanned.select(key, *(F.col(c).alias(f"new_{c}") for c in have), F.lit(True).alias("hit"))
    return old.join(new, key, "left").select(*(F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in have else F.col(c) for c in old.columns))


#: The groups of fields that are written together; each is a setter of its own.
GROUPS = {
    "translation": ("translated_title", "translated_description", "translated_author", "translated_lang"), "scan": SCRAPED, "tags": ("tags",), "thumbnail": ("thumbnail_prompt",),
    "display": ("display_title",), "image": ("video_image_path",), "playlist": ("upload_playlist",), "video": ("video_settings",), "visibility": ("upload_visibility",),
}


def set_fields(metas: DataFrame, group: str, values: DataFrame, key: str = "project") -> DataFrame:
    """``metas`` with one group's fields written for the projects in ``values``; all others stay as they are."""
    fields = [c for c in GROUPS[group] if c in values.columns]
    new = values.select(key, *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("hit"))
    return metas.join(new, key, "left").select(*(F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in metas.columns))


def seeded(metas: DataFrame, refs: DataFrame) -> DataFrame:
    """The pending rows of new projects (title, url) from their contents (url, idx, title, chapter_url)."""
    from textloom.operators.chapters import conformed

    keyed = metas.select("url", project_key(F.col("title"), F.col("url")).alias("project"))
    return conformed(refs.join(keyed, "url").select("project", "idx", "title", F.col("chapter_url").alias("url")))


def without_project(table: DataFrame, project: str) -> DataFrame:
    """The table's next version without a project. A name that is blank or leaves the library is refused."""
    if not project.strip() or "/" in project or "\\" in project or project in (".", ".."):
        raise ValueError(f"not a project of the library: {project!r}")
    return table.where(F.col("project") != project)


def project_folders(listing: DataFrame) -> DataFrame:
    """The folders in a listing (relpath) that hold both a meta and a chapter file."""
    part = listing.select(F.regexp_extract("relpath", "^([^/]+)/([^/]+)$", 1).alias("project"), F.regexp_extract("relpath", "^([^/]+)/([^/]+)$", 2).alias("name"))
    return part.where("project <> ''").groupBy("project").agg(F.bool_or(F.col("name") == "meta.json").alias("meta"), F.bool_or(F.col("name") == "chapters.db").alias("rows")).where("meta AND rows").select("project")


def by_url(metas: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, project): for each address that is not blank the first project, by name, that has it."""
    found = metas.where(F.trim("url") != "").groupBy("url").agg(F.min("project").alias("project"))
    return urls.select("url").distinct().join(found, "url")


def settled(stored: Column, name: str, default: Column, user: Column | None = None) -> Column:
    """A setting as stored, else the user's own, else the default."""
    layers = [stored[F.lit(name)], *([user[F.lit(name)]] if user is not None else [])]
    return F.coalesce(*layers, default)


def one_writer(claims: DataFrame) -> DataFrame:
    """Of the claims (project, worker, at) on each project the one that holds it: the earliest, by name where two are as early."""
    return claims.groupBy("project").agg(F.min_by("worker", F.struct("at", "worker")).alias("worker"))


def request_problem(visibility: Column, suffix: Column, size: Column) -> Column:
    """Why an upload request is refused; null if it is not."""
    known = visibility.isin("public", "private", "unlisted")
    return F.when(~F.coalesce(known, F.lit(False)), "visibility").when(~F.coalesce(F.lower(suffix).isin(".png", ".jpg", ".jpeg"), F.lit(False)), "suffix").when(~F.coalesce(size <= 2 << 20, F.lit(False)), "size")


def destination(recorded: Column, computed: Column) -> Column:
    """Where a project's copies go: where they went before, whatever its name is now."""
    return F.coalesce(F.nullif(F.trim(recorded), F.lit("")), computed)


def export_name(title: Column, translated_title: Column, use_translation: bool, extension: str) -> Column:
    shown = F.when(translated_title != "", translated_title).otherwise(title) if use_translation else title
    return F.concat(slug(shown), F.lit(extension))


def markdown(book: dict[str, Column], skipped: Column, skipped_first: Column, chapters: Column, use_translation: bool) -> Column:
    """A book as Markdown: title, original title, author, description, source, what is missing, then the chapters.

    ``book``: title, translated_title, author, description and note; ``skipped_first``: titles of the
    first missing chapters; ``chapters``: array(struct(title, body)) in order.
    """
    filled = lambda c, text: F.when(c != "", F.concat(text, F.lit("\n\n"))).otherwise("")
    title = F.when(book["translated_title"] != "", book["translated_title"]).otherwise(book["title"]) if use_translation else book["title"]
    original = filled(book["translated_title"], F.concat(F.lit("*Tên gốc: "), book["title"], F.lit("*"))) if use_translation else F.lit("")
    names = F.concat(F.array_join(F.slice(skipped_first, 1, 10), ", "), F.when(skipped > 10, "…").otherwise(""))
    missing = F.when(skipped > 0, F.concat(F.lit("*Bỏ qua "), skipped.cast("string"), F.lit(" chương chưa có nội dung: "), names, F.lit("*\n\n"))).otherwise("")
    body = F.array_join(F.transform(chapters, lambda c: F.concat(F.lit("## "), c["title"], F.lit("\n\n"), c["body"], F.lit("\n"))), "\n")
    return F.concat(
        F.lit("# "), title, F.lit("\n\n"), original, filled(book["author"], F.concat(F.lit("**Tác giả:** "), book["author"])),
        filled(book["description"], F.concat(F.lit("> "), F.replace(book["description"], F.lit("\n"), F.lit("\n> ")))), filled(book["note"], F.concat(F.lit("*"), book["note"], F.lit("*"))), missing, body,
    )


def source_note(url: Column, by: str) -> Column:
    """A line that names the source; none for texts that have no real address."""
    return F.when(F.regexp_like(url, F.lit("^https?://")), F.concat(F.lit("Nguồn: "), url, F.lit(f" — {by}"))).otherwise("")


def front_matter(use_translation: bool) -> tuple[Column, Column]:
    """title and description of a book, translated where there is a translated title."""
    if not use_translation:
        return F.col("title"), F.col("description")
    has = F.col("translated_title") != ""
    return F.when(has, F.col("translated_title")).otherwise(F.col("title")), F.when(has & (F.col("translated_description") != ""), F.col("translated_description")).otherwise(F.col("description"))


def marker_title(title: Column, translated_title: Column, source: Column) -> Column:
    """The label of a voiced chapter: in the language that it was voiced from."""
    return F.when((source == "original") | (translated_title == ""), title).otherwise(translated_title)


def envelope(body: Column, schema: str) -> Column:
    """The data of an answer ``{data, error}``: null where there is an error, no data or no such JSON."""
    read = F.from_json(body, f"data {schema}, error string")
    return F.when(read["error"].isNull(), read["data"])


def published_refs(items: DataFrame, key: str) -> DataFrame:
    """(key, idx, title, id) of the published items of (key, id, number, title, published), in order, renumbered densely; items
    without an id are dropped and a missing title is made from the number."""
    kept = items.where(F.coalesce("published", F.lit(True)) & (F.coalesce("id", F.lit("")) != ""))
    title = F.trim(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chương "), F.coalesce(F.col("number").cast("string"), F.lit("")))))
    order = Window.partitionBy(key).orderBy(F.coalesce("number", F.lit(0)), "id")
    return kept.select(key, (F.row_number().over(order) - 1).alias("idx"), title.alias("title"), "id")


def merged_state(log: DataFrame, keys: list[str], order: list[str], fields: str) -> DataFrame:
    """The state that a log of partial writes (a map of fields each) adds up to: the last value of each field."""
    each = log.select(*keys, *order, F.explode(fields).alias("field", "value"))
    last = each.groupBy(*keys, "field").agg(F.max_by("value", F.struct(*order)).alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("state"))


def schedule_problem(start: Column, now: Column, lead_minutes: int = 15) -> Column:
    """Why a first time cannot be scheduled; null if it can."""
    return F.when(start <= now, "past").when(start - now < F.expr(f"INTERVAL {lead_minutes} MINUTES"), "too soon")


def window_ms(size: Column, bytes_per_second: float, slack: float, least: int, most: int) -> Column:
    """Milliseconds to allow for a transfer, in proportion to its size between two bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.greatest(size, F.lit(0)) / bytes_per_second * 1000 * slack))).cast("long")


def effective_mtime(database: Column, journal: Column) -> Column:
    return F.greatest(database, F.coalesce(journal, database))


def event_escape(text: Column) -> Column:
    """Text for a subtitle event: braces become parentheses, line breaks ``\\N``, a last backslash goes."""
    out = F.translate(text, "{}", "()")
    return F.regexp_replace(F.regexp_replace(out, r"\r\n|\r|\n", r"\\N"), r"\\+$", "")


def cue_snippet(document: Column) -> Column:
    """The start of the first spoken line of a subtitle document, free of quotes; empty if under four letters."""
    lines = F.transform(F.split(document, "\n"), lambda x: F.trim(x))
    said = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^\d+$")) & ~F.contains(x, F.lit("-->")))
    snippet = F.trim(F.regexp_extract(F.substring(F.coalesce(F.get(said, F.lit(0)), F.lit("")), 1, 24), r'^[^"\\]*', 0))
    return F.when(F.length(snippet) >= 4, snippet).otherwise("")


def flag_counts(rows: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    """How many rows of each key have each flag: locked rows, running or paused jobs."""
    return rows.groupBy(*keys).agg(*(F.count_if(flag).alias(name) for name, flag in flags.items()))


def earliest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first scheduled time of each key; a key without any has null."""
    return rows.groupBy(*keys).agg(F.min(at).alias(at))


def isolated(value: Column, raw: Column, problem: str) -> tuple[Column, Column]:
    """A result that may be missing, and the error beside it, so that one bad item stops nothing: ``value`` is
    null where ``raw`` could not be read, which is then told with the first of the text."""
    bad = value.isNull() & raw.isNotNull()
    return value, F.when(bad, F.concat(F.lit(f"{problem}: "), F.substring(raw, 1, 80))).otherwise("")


def fatal(error: Column, signs: tuple[str, ...]) -> Column:
    """Whether an error must end the whole run (a daily limit, a login, a used-up quota) rather than one item."""
    return F.coalesce(F.regexp_like(error, F.lit("(?iu)" + "|".join(signs))), F.lit(False))


# Fixed value: the addresses of projects that came from no site.
LOCAL = "local://"


def local_projects(titles: DataFrame, key: Column) -> DataFrame:
    """(url, title, site) of projects made by hand from (title): each has an address of its own, made from ``key``, which must differ between them, so that no two
    blank addresses are taken for one; a blank title makes no project."""
    named = titles.withColumn("title", F.trim("title")).where("title <> ''")
    return named.select(F.concat(F.lit(LOCAL), F.substring(F.sha2(key.cast("string"), 256), 1, 32)).alias("url"), "title", F.lit("local").alias("site"))


def is_local(url: Column) -> Column:
    return F.startswith(url, F.lit(LOCAL))
