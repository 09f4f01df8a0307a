"""Queries on row edits, project tables, uploads, timelines, labels and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html as ht
from textloom.functions import lines as ln
from textloom.functions import text as tx
from textloom.functions import timeline as tl
from textloom.operators import chapters as ch
from textloom.operators import library as lib
from textloom.operators import sync
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.plans.texts import CLEAN_SQL, DIGEST_SQL, PARAGRAPHS_SQL, SENTENCES_SQL, digest, fold_sql, merge_sql
from textloom.sources import sidecars
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


def ids(spark, sf, rows, *extra):
    """(project, idx) of the chapters that have a label, with columns of the labels."""
    return table(spark, sf, "labels").join(rows.select("project", "idx"), F.col("doc_id") == F.col("idx")).select("project", "idx", *extra)


@query("""WITH {ch} SELECT 'left' AS part, project, count(*) AS n, max(idx) AS top FROM ch WHERE idx NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY project
  UNION ALL SELECT 'deleted', project, count(*), max(idx) FROM ch WHERE idx IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY project""")
def delete_rows(spark, sf):
    rows = chapters(spark, sf)
    left, gone = ch.delete_row(rows, ids(spark, sf, rows, "toxic").where("toxic = 1"))
    sides = [side.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("top")).select(F.lit(name).alias("part"), "project", "n", "top") for name, side in (("left", left), ("deleted", gone))]
    return sides[0].unionByName(sides[1])


@query("""WITH {ch} SELECT idx, CASE WHEN quality = 1 THEN 'new ' || idx ELSE '' END AS translated_title, CASE WHEN quality = 0 THEN 'text' ELSE translated END = 'text' AS rewritten, status, target_lang FROM ch LEFT JOIN labels ON idx = doc_id""")
def edit_translations(spark, sf):
    rows = chapters(spark, sf)
    edits = ids(spark, sf, rows, F.when(F.col("quality") == 1, F.concat(F.lit("new "), F.col("idx").cast("string"))).alias("translated_title"), F.when(F.col("quality") == 0, "text").alias("translated"))
    return ch.edit_translation(rows, edits).select("idx", "translated_title", (F.col("translated") == "text").alias("rewritten"), "status", "target_lang")


@query("""WITH {ch} SELECT idx, CASE WHEN toxic = 0 THEN 'made' WHEN toxic = 1 AND translated <> '' THEN 'error' WHEN translated = '' THEN 'not translated' WHEN audio_path <> '' THEN 'made' ELSE 'not made' END AS shown,
  CASE WHEN toxic = 0 THEN 'a/' || idx ELSE audio_path END AS audio_path, CASE WHEN toxic = 0 THEN 1.5 ELSE audio_seconds END AS audio_seconds FROM ch LEFT JOIN labels ON idx = doc_id WHERE translated <> '' OR coalesce(toxic, 1) = 1""")
def audio_updates(spark, sf):
    """Voices made for some rows and failed for others, and what a list then shows."""
    rows = chapters(spark, sf)
    made = ids(spark, sf, rows, "toxic", F.concat(F.lit("a/"), F.col("idx").cast("string")).alias("audio_path"), F.lit("v").alias("audio_voice"), F.lit(1.5).alias("audio_seconds")).where("toxic = 0").drop("toxic")
    failed = ids(spark, sf, rows, "toxic", F.lit("broke").alias("audio_error")).where("toxic = 1").drop("toxic")
    out = ch.mark_audio_error(ch.save_audio(rows, made), failed)
    untouched = out.join(made.select("project", "idx"), ["project", "idx"], "left_anti")
    shown = out.where("translated <> ''").unionByName(untouched.where("translated = ''"))
    return shown.select("idx", ch.shown_status(True).alias("shown"), "audio_path", "audio_seconds")


@query("""WITH {ch} SELECT count(*) AS n, 0::DOUBLE AS seconds FROM ch""")
def audio_cleared(spark, sf):
    return ch.clear_audio(chapters(spark, sf)).where("audio_path = '' AND audio_voice = ''").agg(F.count(F.lit(1)).alias("n"), F.sum("audio_seconds").alias("seconds"))


@query("""WITH {ch} SELECT idx, CASE WHEN content <> '' AND (translated = '' OR target_lang <> 'en') THEN 'identity' ELSE '' END AS translator, CASE WHEN content <> '' THEN 'translated' ELSE status END AS status, length(CASE WHEN content <> '' THEN content ELSE translated END) AS chars FROM ch WHERE content <> '' OR status = 'pending'""")
def identity_texts(spark, sf):
    out = ch.identity_fill(chapters(spark, sf), "en").where("content <> '' OR status = 'pending'")
    return out.select("idx", "translator", "status", F.length("translated").cast("long").alias("chars"))


@query("""WITH {ch} SELECT idx, CASE WHEN doc_id IS NULL THEN status ELSE 'translated' END AS status, CASE WHEN doc_id IS NULL THEN sha256(content) ELSE sha256('landed ' || idx) END AS content_sha256, CASE WHEN doc_id IS NULL THEN target_lang ELSE 'vi' END AS target_lang FROM ch LEFT JOIN labels ON idx = doc_id""")
def landed_texts(spark, sf):
    rows = chapters(spark, sf)
    texts = ids(spark, sf, rows, F.concat(F.lit("landed "), F.col("idx").cast("string")).alias("content"), F.lit("site").alias("translator"), F.lit("vi").alias("target_lang"))
    return ch.land_translated(rows, texts).select("idx", "status", F.sha2("content", 256).alias("content_sha256"), "target_lang")


@query("""WITH {ch} SELECT idx, title, status, title_custom FROM (SELECT idx, CASE WHEN quality IS NULL THEN title ELSE 'renamed' END AS title, status, quality IS NOT NULL AS title_custom FROM ch LEFT JOIN labels ON idx = doc_id)
  UNION ALL SELECT idx, title, 'undone', false FROM ch JOIN labels ON idx = doc_id WHERE title <> ''""")
def title_edits(spark, sf):
    """Titles that are changed, and changed back."""
    rows = chapters(spark, sf)
    named = ch.edit_title(rows, ids(spark, sf, rows, F.lit("renamed").alias("title")))
    back = ch.reset_title(named, ids(spark, sf, rows)).join(ids(spark, sf, rows), ["project", "idx"], "left_semi")
    return named.select("idx", "title", "status", "title_custom").unionByName(back.where("title_source <> ''").select("idx", "title", F.lit("undone").alias("status"), "title_custom"))


@query("""WITH {ch} SELECT idx, CASE WHEN doc_id IS NULL THEN status WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'translated' ELSE 'downloaded' END AS status, CASE WHEN toxic = 1 THEN 'lost' ELSE '' END AS error FROM ch LEFT JOIN labels ON idx = doc_id""")
def saved_rows(spark, sf):
    """Contents and translations that are saved, and rows that fail."""
    rows = chapters(spark, sf)
    saved = ch.save_content(rows, ids(spark, sf, rows, F.lit("c").alias("content")))
    saved = ch.save_translation(saved, ids(spark, sf, rows, "quality", F.lit("t").alias("translated"), F.lit("vi").alias("target_lang")).where("quality = 1").drop("quality"))
    return ch.mark_error(saved, ids(spark, sf, rows, "toxic", F.lit("lost").alias("error")).where("toxic = 1").drop("toxic")).select("idx", "status", "error")


@query("""WITH {ch} SELECT project, idx FROM ch WHERE audio_path <> '' AND idx % 2 = 0""")
def voiced_files(spark, sf):
    rows = chapters(spark, sf)
    listing = rows.where("idx % 2 = 0").select("project", F.concat(F.lit("audio/"), F.col("idx").cast("string"), F.lit(".mp3")).alias("relpath"))
    return ch.voiced_files(rows, listing).select("project", "idx")


@query("""WITH {ch}, p AS (SELECT DISTINCT project, idx, translated FROM ch JOIN labels ON idx = doc_id) SELECT project, count(*) FILTER (translated <> '') AS kept, count(*) FILTER (translated = '') AS dropped FROM p GROUP BY project""")
def regenerated(spark, sf):
    rows = chapters(spark, sf)
    chosen = ids(spark, sf, rows)
    kept, dropped = ch.regenerable(rows, chosen.unionByName(chosen), True)
    return dropped.join(kept.groupBy("project").agg(F.count(F.lit(1)).alias("kept")), "project", "left").select("project", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "dropped")


@query("""SELECT c_custkey AS project, CASE WHEN s_suppkey IS NULL THEN c_mktsegment ELSE 'a, b' END AS tags, c_name AS title, 'public' AS upload_visibility FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def meta_setters(spark, sf):
    metas = table(spark, sf, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("tags"), F.col("c_name").alias("title"), F.lit("private").alias("upload_visibility"))
    out = lib.set_fields(metas, "tags", table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project"), F.lit("a, b").alias("tags"), F.lit("lost").alias("title")))
    return lib.set_fields(out, "visibility", metas.select("project", F.lit("public").alias("upload_visibility")))


@query("""SELECT n_name AS title, lower(replace(n_name, '_', '-')) AS slug, s_suppkey::BIGINT AS idx, 'pending' AS status, '' AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT contains(n_name, ' ')""")
def seeded_projects(spark, sf):
    nations = table(spark, sf, "nation").where("NOT contains(n_name, ' ')")
    metas = nations.select(F.col("n_name").alias("title"), F.concat(F.lit("u/"), F.col("n_nationkey").cast("string")).alias("url"))
    refs = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("u/"), F.col("n_nationkey").cast("string")).alias("url"), F.col("s_suppkey").alias("idx"), F.col("n_name").alias("name"), F.col("s_name").alias("chapter_url"))
    rows = lib.seeded(metas, refs.withColumnRenamed("name", "title"))
    return rows.select("title", F.regexp_extract("project", "^(.*)-[0-9a-f]{8}$", 1).alias("slug"), "idx", "status", "content")


@query("""WITH {ch} SELECT project, count(*) AS n FROM ch WHERE project <> 'web' GROUP BY project""")
def project_deleted(spark, sf):
    return lib.without_project(chapters(spark, sf), "web").groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey::VARCHAR AS project FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey""")
def project_folders(spark, sf):
    names = F.when(F.col("o_custkey") % 7 == 0, F.array(F.lit("meta.json"))).otherwise(F.array(F.lit("meta.json"), F.lit("chapters.db"), F.lit("x/chapters.db")))
    listing = table(spark, sf, "orders").select("o_custkey", F.explode(names).alias("name")).select(F.concat_ws("/", F.col("o_custkey").cast("string"), "name").alias("relpath"))
    return lib.project_folders(listing)


@query("""SELECT c_mktsegment AS url, min(c_name) AS project FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment""")
def projects_by_url(spark, sf):
    url = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("url")
    metas = table(spark, sf, "customer").select(url, F.col("c_name").alias("project"))
    return lib.by_url(metas, metas.select("url"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stored' WHEN c_custkey % 3 = 1 THEN 'user' ELSE 'default' END AS voice FROM customer""")
def settings_layers(spark, sf):
    k = F.col("c_custkey")
    stored = F.when(k % 3 == 0, F.create_map(F.lit("voice"), F.lit("stored"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    user = F.when(k % 3 != 2, F.create_map(F.lit("voice"), F.lit("user")))
    return table(spark, sf, "customer").select("c_custkey", lib.settled(stored, "voice", F.lit("default"), user).alias("voice"))


@query("""SELECT user_id AS project, arg_min(event_id, (ts, event_id)) AS worker FROM events GROUP BY user_id""")
def one_writer(spark, sf):
    return lib.one_writer(table(spark, sf, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("worker"), F.col("ts").alias("at")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'visibility' WHEN p_partkey % 4 = 1 THEN 'suffix' WHEN p_size > 20 THEN 'size' END AS problem FROM part""")
def request_checks(spark, sf):
    k = F.col("p_partkey") % 4
    problem = lib.request_problem(F.when(k == 0, "secret").otherwise("public"), F.when(k == 1, ".gif").otherwise(".PNG"), F.col("p_size").cast("long") * 100_000)
    return table(spark, sf, "part").select("p_partkey", problem.alias("problem"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept/' || c_custkey ELSE c_name END AS root, lower(replace(c_name, '#', '-')) || '.md' AS export FROM customer""")
def destinations(spark, sf):
    kept = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("kept/"), F.col("c_custkey").cast("string"))).otherwise(" ")
    return table(spark, sf, "customer").select("c_custkey", lib.destination(kept, F.col("c_name")).alias("root"), lib.export_name(F.col("c_name"), F.lit(""), True, ".md").alias("export"))


@query("""SELECT conv_id, sha256('# T' || conv_id || chr(10) || chr(10) || '*Tên gốc: O*' || chr(10) || chr(10) || '**Tác giả:** A' || chr(10) || chr(10) || '> d' || chr(10) || '> e' || chr(10) || chr(10)
  || CASE WHEN count(*) FILTER (coalesce(text, '') = '' OR role = 'user') > 0 THEN '*Bỏ qua ' || count(*) FILTER (coalesce(text, '') = '' OR role = 'user') || ' chương chưa có nội dung: ' || array_to_string(list_slice(list(turn::VARCHAR ORDER BY turn) FILTER (coalesce(text, '') = '' OR role = 'user'), 1, 10), ', ') || CASE WHEN count(*) FILTER (coalesce(text, '') = '' OR role = 'user') > 10 THEN '…' ELSE '' END || '*' || chr(10) || chr(10) ELSE '' END
  || coalesce(string_agg('## ' || turn || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn) FILTER (coalesce(text, '') <> '' AND role <> 'user'), '')) AS book_sha256 FROM conversations GROUP BY conv_id""")
def markdown_books(spark, sf):
    """Whole books with front matter; what the user said stands for chapters without a text."""
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("string").alias("title"), "turn", F.when(F.col("role") != "user", F.coalesce("text", F.lit(""))).otherwise("").alias("body"))
    book = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "title", "body"))).alias("rows"))
    missing, there = F.filter("rows", lambda r: r["body"] == ""), F.filter("rows", lambda r: r["body"] != "")
    front = {"title": F.lit("O"), "translated_title": F.concat(F.lit("T"), F.col("conv_id").cast("string")), "author": F.lit("A"), "description": F.lit("d\ne"), "note": F.lit("")}
    text = lib.markdown(front, F.size(missing), F.transform(missing, lambda r: r["title"]), there, True)
    return book.select("conv_id", F.sha2(text, 256).alias("book_sha256"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'published' WHEN 2 THEN 'draft' WHEN 3 THEN 'unknown' ELSE '' END AS status, event_id % 5 = 1 AS published, event_id % 5 IN (2, 3) AS unresolved, event_id % 5 = 2 AS draft, event_id % 5 = 0 AS uploadable FROM events""")
def upload_lifecycle(spark, sf):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, '{"status": "published", "video_id": "a"}').when(k == 2, '{"status": "draft", "video_id": "b"}').when(k == 3, "{broken").otherwise('{"error": "x"}')
    life = sync.lifecycle(raw)
    return table(spark, sf, "events").select("event_id", *(life[c].alias(c) for c in ("status", "published", "unresolved", "draft", "uploadable")))


PARTS_SQL = "p AS (SELECT o_custkey AS project, o_orderkey::VARCHAR AS folder, o_orderkey % 5 AS k FROM orders)"


def parts(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 1, '{"status": "published", "video_id": "a"}').when(k == 2, '{"status": "draft", "video_id": "b"}').when(k == 3, "{broken").otherwise(F.lit(None).cast("string"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("folder"), k.alias("k"), raw.alias("json"), F.when(k == 4, "a.srt").otherwise("a.MP4").alias("name"), F.lit(1).alias("size"))


@query(f"WITH {PARTS_SQL} SELECT 'candidate' AS kind, project, folder FROM p WHERE k = 1 UNION ALL SELECT 'pending', project, folder FROM p WHERE k IN (0, 4) UNION ALL SELECT 'remote', project, folder FROM p WHERE k IN (1, 2)")
def part_selections(spark, sf):
    """Parts whose video may go once it is confirmed, parts still to be sent, and parts that a store knows."""
    rows, keys = parts(spark, sf), ["project", "folder"]
    found = {"candidate": sync.video_candidates(rows, rows), "pending": sync.pending_parts(rows, rows, keys), "remote": sync.with_remote_id(rows, rows, keys)}
    out = [df.select(F.lit(kind).alias("kind"), *keys) for kind, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT l_orderkey || '/' || l_linenumber AS relpath, count(*) > 0 AS seen, bool_or(l_quantity <= 25) AS backed_up FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def backup_claims(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"))
    items = one.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("relpath"), "size", F.lit(10.0).alias("mtime"))
    manifest = items.select("relpath", "size", F.lit("9").alias("mtime"), F.when(F.col("size") <= 25, "done").otherwise("sending").alias("status"))
    return sync.claims_backed_up(items, manifest).select("relpath", F.lit(True).alias("seen"), "backed_up")


@query("""SELECT o_custkey AS project, count(*) AS parts, sum(o_orderkey % 9)::BIGINT AS chapters, sum(o_orderkey * 10)::DOUBLE AS seconds FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey""")
def unrendered_parts(spark, sf):
    k = F.col("o_orderkey")
    windows = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), k.alias("first"), (k + 1).alias("last"), (k % 9).alias("chapters"), (k * 10).cast("double").alias("seconds"))
    return sync.unrendered(windows, windows.where("first % 3 = 0").select("project", "first", "last"), 5.0).drop("hours")


@query("""WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS cleared FROM events GROUP BY user_id), e AS (SELECT e.*, cleared FROM events e JOIN l USING (user_id))
  SELECT user_id, arg_max(event_type, event_id) AS status FROM e WHERE event_type <> 'error' AND (cleared IS NULL OR event_id > cleared) GROUP BY user_id""")
def state_after_reset(spark, sf):
    """A log of states in which an error clears all that was before."""
    fields = F.when(F.col("event_type") != "error", F.create_map(F.lit("status"), F.col("event_type")))
    log = table(spark, sf, "events").select("user_id", F.col("event_id").alias("at"), fields.alias("fields"))
    return sync.state_of_log(log, ["user_id"]).select("user_id", F.col("state")["status"].alias("status"))


@query("""SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) END AS size, CASE WHEN o_custkey % 2 = 0 THEN count(*) FILTER (o_orderkey % 2 = 0) ELSE 0 END AS folders FROM orders GROUP BY o_custkey""")
def remote_listings(spark, sf):
    """Names and sizes as two columns of a page; where these do not match, sizes are unknown and nothing is a folder."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    names, right = F.transform("ks", lambda k: k.cast("string")), F.col("o_custkey") % 2 == 0
    sizes = F.when(right, F.col("ks")).otherwise(F.concat("ks", F.array(F.lit(1).cast("long"))))
    kinds = F.transform(sizes, lambda k: F.when(k % 2 == 0, " Folder").otherwise("file"))
    return rows.select("o_custkey", sync.remote_sizes(names, sizes)[F.array_max("ks").cast("string")].alias("size"), F.size(sync.only_folders(names, kinds)).cast("long").alias("folders"))


@query("""WITH s AS (SELECT *, coalesce(sum(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS "offset" FROM conversations)
  SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS covered, max("offset" + 0.5) FILTER (role = 'assistant') AS last_start FROM s GROUP BY conv_id""")
def cue_coverage(spark, sf):
    segment = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), segment.alias("segment"), (F.col("turn") + 1).cast("double").alias("seconds"), "role")
    cues = rows.where("role = 'assistant'").select("segment", F.lit(0.5).alias("start"), F.lit(0.9).alias("end"), F.lit("x").alias("text"))
    moved, covered = tl.part_cues(rows.drop("role"), cues, ["conv_id"])
    return covered.join(moved.groupBy("conv_id").agg(F.max("start").alias("last_start")), "conv_id", "left")


@query("""WITH {ch}, w AS (SELECT project, idx + 1 AS n FROM ch WHERE audio_path <> '')
  SELECT 'all' AS mode, project, 1 AS part, min(n)::INT AS first, max(n)::INT AS last, count(*) AS size FROM w GROUP BY project
  UNION ALL SELECT 'range', project, 1, min(n)::INT, max(n)::INT, count(*) FROM w WHERE n BETWEEN 5 AND 90 GROUP BY project
  UNION ALL SELECT 'batch', project, ((n - 1) // 20 + 1)::INT, min(n)::INT, max(n)::INT, count(*) FROM w GROUP BY ALL""")
def merge_windows(spark, sf):
    rows = chapters(spark, sf).where("audio_path <> ''")
    made = {"all": {}, "range": {"start": 5, "end": 90}, "batch": {"batch": 20}}
    out = [tl.merge_windows(rows, ["project"], mode, **more).select(F.lit(mode).alias("mode"), "project", "part", "first", "last", "size") for mode, more in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 9000 AS t FROM orders) SELECT o_orderkey,
  CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS hms,
  CASE WHEN t <= 0 THEN '' WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN printf('%dm%02ds', t // 60, t % 60) ELSE printf('%dh%02dm', t // 3600, t // 60 % 60) END AS compact, t > 7200 AS too_long,
  t / CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 1.25 END AS gap, CASE WHEN t // 5 < 3600 THEN '~' || round(t / 300.0)::INT || ' phút' END AS estimate FROM s WHERE t % 300 <> 150""")
def durations(spark, sf):
    t = (F.col("o_orderkey") % 9000).cast("double")
    rows = table(spark, sf, "orders").where("o_orderkey % 9000 % 300 <> 150")
    return rows.select("o_orderkey", tl.hms(t).alias("hms"), tl.compact(t).alias("compact"), tl.too_long(t, 2).alias("too_long"), tl.expected_gap(t, F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(1.25)).alias("gap"), ln.render_estimate(t, F.lit(5.0)).alias("estimate"))


@query("""WITH e AS (SELECT conv_id, turn, coalesce(sum(2.5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM conversations)
  SELECT conv_id, 'Book' || chr(10) || chr(10) || string_agg(printf('%d:%02d', floor(t)::INT // 60, floor(t)::INT % 60) || ' ' || turn, chr(10) ORDER BY turn) AS description, string_agg(printf('0:%02d:%05.2f', floor(t)::INT // 60, t % 60), ' ' ORDER BY turn) AS starts FROM e GROUP BY conv_id""")
def video_documents(spark, sf):
    """A video's description, and the starts that its subtitle document shows."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") * 0 + 2.5).alias("seconds")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    events = F.transform("turns", lambda t, i: F.struct((i * 2.5).cast("double").alias("start"), (i * 2.5 + 2).cast("double").alias("end"), t.cast("string").alias("text"), t.cast("string").alias("title")))
    made = rows.select("conv_id", tl.description(F.lit("Book"), events).alias("description"), tl.ass_document(events, F.lit("Book")).alias("ass"))
    return made.select("conv_id", "description", F.array_join(F.regexp_extract_all("ass", F.lit(r"Dialogue: 0,([\d:.]+),"), F.lit(1)), " ").alias("starts"))


@query("""SELECT o_custkey, count(*) = 3 AS exact, CASE WHEN count(*) = 3 THEN min(o_orderkey)::DOUBLE END AS first_end FROM orders GROUP BY o_custkey""")
def gap_cues(spark, sf):
    """Chunks laid between pauses; customers with three orders stand for files with a pause between each two of four chunks."""
    gaps = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("double").alias("start"), (k + 0.5).cast("double").alias("end"))).alias("gaps"))
    cues = tl.gap_cues(F.array(*map(F.lit, "abcd")), F.col("gaps"), F.lit(1e9))
    return gaps.select("o_custkey", cues.isNotNull().alias("exact"), F.get(cues, F.lit(0))["end"].alias("first_end"))


@query("""SELECT user_id, event_id, ts::DATE::TIMESTAMP + to_days(((row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) - 1) * 2)::INT) AS at FROM events""")
def spaced_schedule(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.to_date("ts").cast("timestamp_ntz").alias("day"))
    return tl.schedule(rows, ["user_id", "day"], ["event_id"], F.col("day"), 2).select("user_id", "event_id", "at")


@query("""WITH p AS (SELECT doc_id, unnest([1, 2, 3]) AS poll, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || unnest([1, 2, 3]) END AS text FROM documents) SELECT doc_id, poll FROM p WHERE poll = 3 AND doc_id % 2 = 0 AND length(text) > 400""")
def settled_polls(spark, sf):
    polls = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("poll"))
    text = F.when(F.col("doc_id") % 2 == 0, F.col("body")).otherwise(F.concat("body", F.col("poll").cast("string")))
    return tl.settled(polls.select("doc_id", "poll", text.alias("text")), ["doc_id"], "poll", "text").select("doc_id", "poll")


@query(f"""WITH c AS (SELECT doc_id, {CLEAN_SQL.replace("coalesce(text, '')", "('Title' || chr(10) || chr(10) || coalesce(text, ''))")} AS text FROM documents), ps AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM (SELECT doc_id, {PARAGRAPHS_SQL.replace("chr(10)", "chr(10) || chr(10)").replace("trim(p)", "trim(p, chr(32) || chr(10))")} AS ps FROM c)),
  k AS (SELECT doc_id, pos, {fold_sql("s", 400, "' '")} AS chunks FROM (SELECT doc_id, pos, {SENTENCES_SQL.replace("trim(s)", "trim(s, chr(32) || chr(10))")} AS s FROM ps)), f AS (SELECT doc_id, flatten(list(chunks ORDER BY pos)) AS chunks FROM k GROUP BY doc_id), m AS (SELECT doc_id, {merge_sql("chunks", 30, 400)} AS chunks FROM f)
  SELECT doc_id, coalesce(len(chunks), 0)::INT AS n, {DIGEST_SQL.format("coalesce(chunks, [])")} AS chunks_sha256 FROM documents LEFT JOIN m USING (doc_id)""")
def voice_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.voice_chunks(F.lit("Title"), tx.text_of("text")).alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n"), digest("chunks").alias("chunks_sha256"))


@query("""SELECT p_partkey, 'M ' || p_size || '.5' AS label, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'og' END AS title, CASE p_partkey % 3 WHEN 0 THEN 'Google Translate' WHEN 1 THEN 'Claude API (m)' ELSE 'CLI (agy)' END AS engine, CASE WHEN p_size % 2 = 0 THEN trim(p_name) ELSE trim(p_name) || ' - Phần ' || p_size END AS upload_title, '&H00' || 'CCBBAA' AS colour, '/x/' || p_partkey || '.cues.json' AS beside, greatest(12, round(p_size * 0.5 - 0.01))::INT AS px FROM part""")
def small_labels(spark, sf):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    option = F.concat(F.lit("AI M  "), size, F.lit(".5 - Memory - No Apikey"))
    heading = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Truyện "), "p_name")).otherwise("")
    engine = ln.engine_label(F.when(k == 0, "google").when(k == 1, "claude").otherwise("cli"), F.when(k == 1, "m").otherwise(""), F.lit(" agy run"))
    return table(spark, sf, "part").select(
        "p_partkey", ln.model_label(option).alias("label"), ln.plain_title(heading, F.lit("[Mới] og - Đọc Truyện Online | x")).alias("title"), engine.alias("engine"), ln.upload_title(F.col("p_name"), F.when(F.col("p_size") % 2 == 1, F.col("p_size"))).alias("upload_title"),
        ln.ass_colour(F.lit("#aabbcc")).alias("colour"), ln.beside(F.concat(F.lit("/x/"), F.col("p_partkey").cast("string"), F.lit(".mp3")), ".cues.json").alias("beside"), ln.share_of(F.col("p_size") - 0.02, 0.5, 12).alias("px"),
    )


@query("""SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size % 2 = 0, -p_size, p_partkey) AS ranked FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand""")
def ranked_models(spark, sf):
    name = F.concat(F.lit("m "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " LITE").otherwise(""), F.when(F.col("p_partkey") % 3 != 0, " Memory no apikey #").otherwise(" none #"), F.col("p_partkey").cast("string"))
    lists = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", name.alias("name")))).alias("rows"))
    return lists.select("p_brand", F.array_join(F.transform(ln.ranked_models(F.transform("rows", lambda r: r["name"])), lambda n: F.substring_index(n, "#", -1)), ",").alias("ranked"))


@query("""SELECT doc_id, 'Make tags' || chr(10) || chr(10) || 'Title: T' || CASE WHEN trim(left(trim(coalesce(text, ''), chr(10) || chr(32) || chr(9)), 600), chr(10) || chr(32) || chr(9)) <> '' THEN chr(10) || chr(10) || 'Opening: ' || trim(left(trim(coalesce(text, ''), chr(10) || chr(32) || chr(9)), 600), chr(10) || chr(32) || chr(9)) ELSE '' END AS prompt FROM documents""")
def prompts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ln.prompt("Make tags", F.lit("T"), F.lit(""), ln.stripped(tx.text_of("text"))).alias("prompt"))


@query(r"""SELECT page_id, greatest(coalesce(list_max(list_transform(regexp_extract_all(html, 'href="/[a-z]*([a-z])', 1), lambda c: ascii(c) - 96)), 1), 1)::INT AS last, CASE WHEN page_id % 2 = 0 THEN 'business' ELSE '' END AS flavour, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/chuong-' || page_id AS chapter FROM pages""")
def page_addresses(spark, sf):
    """The largest page number, the store an address is of, and addresses made from it."""
    letters = F.transform(F.regexp_extract_all("html", F.lit(r'href="/[a-z]*([a-z])'), F.lit(1)), lambda c: F.concat(F.lit('<a href="?x=1&ch='), (F.ascii(c) - 96).cast("string"), F.lit('">')))
    store = F.when(F.col("page_id") % 2 == 0, "https://a-my.sharepoint.com/1drv.ms").otherwise("https://x.org/")
    origin = ln.origin_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", ln.last_page(F.array_join(letters, "")).alias("last"), ln.store_flavour(store).alias("flavour"), origin.alias("origin"), ln.chapter_url(F.concat(origin, F.lit("//")), F.col("page_id")).alias("chapter"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, '/chuong-' || (o_orderkey % 20) || '-x' AS href FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, href ORDER BY o_orderkey) AS k FROM t)
  SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY split_part(href, '-', 2)::INT, o_orderkey) - 1)::INT AS idx, 'a ' || o_orderkey AS title, 'https://x.org' || href AS url FROM f WHERE k = 1""")
def toc_reading_order(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_custkey", F.lit("https://x.org/truyen/y").alias("base"), k.alias("pos"), F.concat(F.lit("/chuong-"), (k % 20).cast("string"), F.lit("-x")).alias("href"), F.concat(F.lit(" a \n "), k.cast("string")).alias("title"))
    none = rows.withColumn("href", F.lit("/other/9"))
    return ht.reading_order(rows.unionByName(none), "o_custkey")


@query("""SELECT conv_id, turn, len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''))::INT AS lines, CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 2 END AS paragraphs, CASE WHEN turn % 2 = 0 THEN 'mine' END AS story FROM conversations""")
def page_parts(spark, sf):
    """Lines of a marked-up text, streamed paragraphs without their citations, and the story that a page is about."""
    text = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<p>menu</p><p class="fade-in-paragraph has-anchor"><a class="citation-anchor">#</a>'), safe, F.lit('</p><p class="x fade-in-paragraph"><a class="citation-anchor" href="#2">#</a> last</p>'))
    story = lambda slug, title: F.create_map(F.lit("storySlug"), F.lit(slug), F.lit("slug"), F.lit("other"), F.lit("title"), F.lit(title))
    objects = F.when(F.col("turn") % 2 == 0, F.array(story("b", "theirs"), story("a", "mine"))).otherwise(F.array(story("b", "theirs")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(ht.paragraphs_of(F.concat(F.lit("<br>"), F.replace(safe, F.lit("\n"), F.lit("<br/>"))))).alias("lines"), F.size(ht.ai_paragraphs(html)).alias("paragraphs"), ht.own_story(objects, F.lit("a"))["title"].alias("story"))


@query("""SELECT user_id, 'E' AS kind, count(*) AS files, sum(event_id)::BIGINT AS bytes, '' AS note FROM events GROUP BY user_id""")
def manifests_written(spark, sf):
    """Manifests written as documents and read back."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.lit("r").alias("remote_root"), F.lit("a").alias("account"), F.lit("t").alias("updated_at"), F.col("event_id").cast("string").alias("relpath"), F.col("event_id").alias("size"), F.lit("1").alias("mtime"), F.lit("done").alias("status"), F.lit("t").alias("uploaded_at"))
    raw = sidecars.manifest_json(rows)
    read = sidecars.parsed_manifest(raw).groupBy("key").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return read.join(sidecars.manifest_notes(raw), "key").select(F.col("key").alias("user_id"), F.lit("E").alias("kind"), "files", "bytes", "note")


@query("""SELECT o_orderkey, o_orderkey % 4 = 1 AS quota, o_orderkey % 4 = 2 AS broken, o_orderkey % 3 <> 0 AS decoration FROM orders""")
def line_classes(spark, sf):
    """Quota messages, error answers within prose, and rows of a list page that are no names."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    message = F.when(k % 4 == 1, "Not enough storage left").when(k % 4 == 2, F.concat(F.lit('He went on {"error": {"code": '), key, F.lit("}}"))).otherwise("Error 404 was the street")
    row = F.when(k % 3 == 0, F.concat(F.lit("Playlist "), key)).when(k % 3 == 1, F.concat(key, F.lit(" videos"))).otherwise(" Private ")
    return table(spark, sf, "orders").select("o_orderkey", ln.is_quota_error(message).alias("quota"), ln.looks_like_error(message).alias("broken"), ln.is_list_decoration(row).alias("decoration"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS locked, count(*) FILTER (value > 100) AS running, count(*) FILTER (value <= 100 AND event_type = 'click') AS paused, min(ts) FILTER (event_type = 'signup') AS ts FROM events GROUP BY user_id""")
def job_counts(spark, sf):
    rows = table(spark, sf, "events")
    kind, value = F.col("event_type"), F.col("value")
    counts = lib.flag_counts(rows, ["user_id"], locked=kind == "error", running=value > 100, paused=(value <= 100) & (kind == "click"))
    return counts.join(lib.earliest(rows.select("user_id", F.when(kind == "signup", F.col("ts")).alias("ts")), ["user_id"], "ts"), "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id END AS value, CASE WHEN event_id % 3 = 0 THEN 'no number: ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' quota' ELSE '' END ELSE '' END AS error, event_id % 6 = 0 AS fatal FROM events""")
def isolated_errors(spark, sf):
    """Items that cannot be read, with their errors beside the results of the others."""
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.concat("event_type", F.when(k % 2 == 0, " quota").otherwise(""))).otherwise(k.cast("string"))
    value, error = lib.isolated(raw.try_cast("long"), raw, "no number")
    return table(spark, sf, "events").select("event_id", value.alias("value"), error.alias("error"), lib.fatal(error, ("quota", "log in")).alias("fatal"))
