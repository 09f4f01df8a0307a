"""Queries on the chapter table: lifecycle, updates and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import first_filled
from textloom.operators import chapters as ch
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its oracle; ``{ch}`` stands for the chapter table."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


@query("""WITH {ch} SELECT project, count(*) AS total, count(*) FILTER (content <> '') AS downloaded, count(*) FILTER (translated <> '') AS translated,
  count(*) FILTER (audio_path <> '') AS voiced, count(*) FILTER (status = 'error') AS errors FROM ch GROUP BY project""")
def lifecycle_counts(spark, sf):
    return ch.counts(chapters(spark, sf), "project")


@query("WITH {ch} SELECT project, idx FROM ch WHERE content = '' AND idx >= 10 AND idx <= 900")
def pending_download(spark, sf):
    return ch.pending_download(chapters(spark, sf), 10, 900).select("project", "idx")


@query("WITH {ch} SELECT project, idx, status FROM ch WHERE idx BETWEEN 100 AND 300")
def range_scan(spark, sf):
    return ch.in_range(chapters(spark, sf), 100, 300).select("project", "idx", "status")


@query("WITH {ch} SELECT project, idx, target_lang FROM ch WHERE content <> '' AND (translated = '' OR target_lang <> 'en')")
def pending_translation(spark, sf):
    return ch.pending_translation(chapters(spark, sf), "en").select("project", "idx", "target_lang")


@query("""WITH {ch} SELECT 'translated' AS variant, project, idx FROM ch WHERE translated <> '' AND (audio_path = '' OR audio_voice <> 'en' OR audio_source <> 'translated')
  UNION ALL SELECT 'original', project, idx FROM ch WHERE content <> '' AND (audio_path = '' OR audio_source <> 'original')""")
def pending_audio(spark, sf):
    rows = chapters(spark, sf)
    one, two = ch.pending_audio(rows, "en", True), ch.pending_audio(rows, "", False)
    return one.select(F.lit("translated").alias("variant"), "project", "idx").unionAll(two.select(F.lit("original").alias("variant"), "project", "idx"))


@query("WITH {ch} SELECT project, idx, status FROM ch WHERE status = 'error'")
def errored_rows(spark, sf):
    return ch.errored(chapters(spark, sf)).select("project", "idx", "status")


@query("WITH {ch} SELECT project, min(idx) AS idx FROM ch WHERE url = 'https://src9.example/29' AND url <> '' GROUP BY project ORDER BY project LIMIT 1")
def url_lookup(spark, sf):
    hit = chapters(spark, sf).where((F.col("url") == "https://src9.example/29") & (F.col("url") != ""))
    return hit.groupBy("project").agg(F.min("idx").alias("idx")).orderBy("project").limit(1)


@query("WITH {ch} SELECT project, idx, status FROM ch WHERE idx = 42")
def point_lookup(spark, sf):
    return chapters(spark, sf).where("idx = 42").select("project", "idx", "status")


@query("""WITH {ch} SELECT project, idx, coalesce(nullif(trim(target_lang), ''), nullif(trim(status), ''), nullif(trim(audio_voice), ''), '') AS name FROM ch""")
def first_non_blank(spark, sf):
    return chapters(spark, sf).select("project", "idx", first_filled(F.col("target_lang"), F.col("status"), F.col("audio_voice")).alias("name"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.color'), json_extract_string(props, '$.k'), 'none') AS setting FROM events""")
def settings_resolve(spark, sf):
    stored = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(stored, F.lit("color")), F.try_element_at(stored, F.lit("k")), F.lit("none")).alias("setting"))


@query("""WITH {ch} SELECT project, idx, CASE WHEN status = 'error' THEN 'failed' WHEN audio_path <> '' AND audio_source = 'original' THEN 'voiced (original)'
  WHEN audio_path <> '' THEN 'voiced' WHEN translated <> '' THEN 'ready' WHEN content <> '' THEN 'fetched' ELSE 'waiting' END AS shown FROM ch""")
def status_display(spark, sf):
    voiced = F.col("audio_path") != ""
    shown = (
        F.when(F.col("status") == "error", "failed").when(voiced & (F.col("audio_source") == "original"), "voiced (original)").when(voiced, "voiced")
        .when(F.col("translated") != "", "ready").when(F.col("content") != "", "fetched").otherwise("waiting")
    )
    return chapters(spark, sf).select("project", "idx", shown.alias("shown"))


@query("""WITH {ch}, e AS (SELECT idx, status, content, 'clear' AS step, CASE WHEN translated <> '' THEN CASE WHEN content = '' THEN 'pending' ELSE 'downloaded' END ELSE status END AS after FROM ch
  UNION ALL SELECT idx, status, content, 'reset', CASE WHEN status = 'error' THEN CASE WHEN content = '' THEN 'pending' ELSE 'downloaded' END ELSE status END FROM ch
  UNION ALL SELECT c.idx, status, content, 'edit', CASE WHEN l.doc_id IS NOT NULL AND status IN ('pending', 'error') THEN 'downloaded' ELSE status END FROM ch c LEFT JOIN labels l ON l.doc_id = c.idx)
  SELECT step, status AS before, after, count(*) AS n FROM e GROUP BY ALL""")
def status_transitions(spark, sf):
    rows = chapters(spark, sf)
    texts = table(spark, sf, "labels").join(rows.select("project", "idx"), F.col("doc_id") == F.col("idx")).select("project", "idx", F.lit("new text").alias("content"))
    rows = rows.withColumn("before", F.col("status"))
    steps = {"clear": ch.clear_translations(rows), "reset": ch.reset_errors(rows), "edit": ch.edit_content(rows, texts)}
    out = [after.select(F.lit(step).alias("step"), "before", F.col("status").alias("after")) for step, after in steps.items()]
    out = out[0].unionAll(out[1]).unionAll(out[2])
    return out.groupBy("step", "before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH {ch}, refs AS (SELECT s_name AS project, s_suppkey + 500 AS idx, s_name AS title, 'u' || s_suppkey AS url FROM supplier
    UNION ALL SELECT project, idx, 'again ' || idx, url || '?v=2' FROM ch WHERE status <> 'error')
  SELECT coalesce(c.project, r.project) AS project, coalesce(c.idx, r.idx) AS idx, CASE WHEN r.url IS NOT NULL THEN r.title ELSE c.title END AS title, coalesce(r.url, c.url) AS url,
    CASE WHEN c.idx IS NULL THEN '' WHEN r.url IS NOT NULL THEN r.title ELSE '' END AS title_source, coalesce(c.status, 'pending') AS status
  FROM ch c FULL JOIN refs r ON c.project = r.project AND c.idx = r.idx""")
def toc_upsert(spark, sf):
    rows = chapters(spark, sf)
    fresh = table(spark, sf, "supplier").select(F.col("s_name").alias("project"), (F.col("s_suppkey") + 500).cast("long").alias("idx"), F.col("s_name").alias("title"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"))
    again = rows.where("status <> 'error'").select("project", "idx", F.concat(F.lit("again "), F.col("idx").cast("string")).alias("title"), F.concat("url", F.lit("?v=2")).alias("url"))
    return ch.replace_toc(rows, fresh.unionByName(again), now="2000-01-01T00:00:00+00:00").select("project", "idx", "title", "url", "title_source", "status")


@query("""WITH {ch}, top AS (SELECT project, max(idx) AS top FROM ch GROUP BY project),
  new AS (SELECT 'src' || (p_partkey % 25) AS project, p_partkey AS pos, trim(p_name) AS title FROM part WHERE trim(p_name) <> '')
  SELECT n.project, coalesce(top, -1) + row_number() OVER (PARTITION BY n.project ORDER BY pos) AS idx, title FROM new n LEFT JOIN top USING (project)""")
def append_max_plus_one(spark, sf):
    titles = table(spark, sf, "part").select(F.concat(F.lit("src"), (F.col("p_partkey") % 25).cast("string")).alias("project"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return ch.append_rows(chapters(spark, sf), titles)


@query("""WITH {ch}, m AS (SELECT project, idx, (length(title) - length(replace(title, 'the', ''))) // 3 AS a, (length(content) - length(replace(content, 'the', ''))) // 3 AS b FROM ch)
  SELECT project, idx, a + b AS matches, (a > 0)::INT + (b > 0)::INT AS fields FROM m WHERE a + b > 0""")
def find_replace_scan(spark, sf):
    found = ch.find(chapters(spark, sf), "the", fields=("title", "content"), new="THE")
    total = F.aggregate("changes", F.lit(0), lambda acc, x: acc + x["n"])
    return found.select("project", "idx", total.cast("long").alias("matches"), F.size("changes").alias("fields"))


@query("""WITH {ch} SELECT project, idx, replace(title, 'the', '$1') AS title, sha256(replace(content, 'the', '$1')) AS content_sha256 FROM ch""")
def apply_diffs(spark, sf):
    """The differences that a search finds, and the very values it showed written to the rows."""
    rows = chapters(spark, sf)
    out = ch.apply_changes(rows, ch.find(rows, "the", fields=("title", "content"), new="$1"))
    return out.select("project", "idx", "title", F.sha2("content", 256).alias("content_sha256"))


@query("""WITH {ch} SELECT project, idx, replace(title, 'the', '$1') AS title, sha256(replace(content, 'the', '$1')) AS content_sha256 FROM ch""")
def replaced_rows(spark, sf):
    """The same in one pass, where nobody looks at the differences first."""
    out = ch.replaced(chapters(spark, sf), "the", "$1", fields=("title", "content"))
    return out.select("project", "idx", "title", F.sha2("content", 256).alias("content_sha256"))


@query("""WITH {ch} SELECT project, idx, CASE WHEN translated <> '' THEN title END AS title, CASE WHEN translated <> '' THEN length(translated) END AS body_chars FROM ch""")
def text_choice(spark, sf):
    return ch.text_choice(chapters(spark, sf), True).select("project", "idx", "title", F.length("body").cast("long").alias("body_chars"))


@query("""WITH {ch} SELECT project, count(*) FILTER (translated <> '') AS included, count(*) FILTER (translated = '') AS skipped,
  list_slice(list(idx ORDER BY idx) FILTER (translated = ''), 1, 10)::VARCHAR AS first_skipped FROM ch GROUP BY project""")
def export_split(spark, sf):
    found = ch.first_missing(chapters(spark, sf), F.col("translated") == "", 10)
    return found.select("project", "included", "skipped", F.concat(F.lit("["), F.array_join("first", ", "), F.lit("]")).alias("first_skipped"))
