"""Queries on small parsers, selections and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import lines as ln
from textloom.functions import timeline as tl
from textloom.operators import chapters as ch
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


@query("""SELECT o_orderkey, k IN (0, 2, 3, 4) AS done, CASE WHEN k IN (0, 1) THEN o_custkey::INT END AS count, CASE k WHEN 1 THEN 17 WHEN 2 THEN 100 WHEN 4 THEN 17 END AS percent, k IN (0, 2, 4) AS video_done FROM (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k FROM orders)""")
def progress_lines(spark, sf):
    k, cust = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("Uploaded "), cust, F.lit(" files"))).when(k == 1, F.concat(F.lit("Đang tải lên "), cust, F.lit(" mục, 17 %"))).when(k == 2, "Uploading 100%").when(k == 3, "Hoàn tất").when(k == 4, "Upload complete. Now processing 17%").otherwise("idle")
    p, video = ln.progress(line), ln.progress(line, "video")
    return table(spark, sf, "orders").select("o_orderkey", p["done"].alias("done"), p["count"].alias("count"), p["percent"].alias("percent"), video["done"].alias("video_done"))


@query("""SELECT p_partkey, regexp_replace(p_partkey || '. ' || p_name, '^\\s*\\d+\\s*[.、]\\s*', '') AS title, trim(regexp_replace(p_name || ' NEW VIP', '(?:\\s*(?:NEW|VIP))+\\s*$', '')) AS plain FROM part""".replace("\\\\", "\\"))
def title_strips(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ln.without_index(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_name")).alias("title"), ln.without_badges(F.concat("p_name", F.lit(" NEW VIP")), ["NEW", "VIP"]).alias("plain"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN 1715 WHEN 2 THEN NULL ELSE page_id END AS number, list_filter(string_split(regexp_replace(split_part(url, '?', 1), '^https?:/', ''), '/'), lambda x: x <> '')[1] AS host FROM pages""")
def chapter_numbers(spark, sf):
    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    href = F.when(k == 0, F.concat(F.lit("/truyen/7/chuong-"), key, F.lit("-vao-bo-9"))).when(k == 1, "/truyen/chuong-lau-don-3-chuong-1715").when(k == 2, F.concat(F.lit("/book"), key, F.lit("/part"))).otherwise(F.concat(F.lit("/chuong-1/chuong-"), key))
    return table(spark, sf, "pages").select("page_id", ln.chapter_number(href).alias("number"), F.get(ln.segments(F.regexp_replace(F.substring_index("url", "?", 1), "^https?:/", "")), F.lit(0)).alias("host"))


@query("""WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS last FROM events GROUP BY user_id)
  SELECT l.user_id, CASE WHEN e.event_id IS NULL THEN '' WHEN event_type = 'error' THEN 'hết hạn mức (quota) của agy (reset sau 2h' || e.event_id || 'm). Chờ reset hoặc đổi engine trong Cài đặt.' ELSE 'call ' || e.event_id || ' failed' END AS error FROM l LEFT JOIN events e ON e.event_id = last[2]""")
def error_logs(spark, sf):
    """Logs in which purchases stand for a message that is said twice, and errors for a used-up quota."""
    key = F.col("event_id").cast("string")
    twice = F.concat(F.lit("call "), key, F.lit(" failed"))
    said = F.when(F.col("event_type") == "purchase", F.concat(F.lit("E0705 12:34:56 a.go:1] "), twice, F.lit(": "), twice)).when(F.col("event_type") == "error", F.concat(F.lit("E0705 12:34:56 a.go:1] RESOURCE_EXHAUSTED. Resets in 2h"), key, F.lit("m."))).otherwise(F.concat(F.lit("I0705 no error] "), "event_type"))
    log = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", said.alias("s")))).alias("rows"))
    return log.select("user_id", ln.last_error(F.array_join(F.transform("rows", lambda r: r["s"]), "\n")).alias("error"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '') AS ws FROM part)
  SELECT p_partkey, array_to_string(string_split(list_reduce(ws, lambda acc, x: CASE WHEN (CASE WHEN strpos(acc, chr(30)) = 0 THEN length(acc) ELSE strpos(reverse(acc), chr(30)) - 1 END) + 1 + length(x) <= 18 THEN acc || ' ' || x ELSE acc || chr(30) || x END), chr(30)), chr(10)) AS wrapped FROM w""")
def word_wrap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(ln.wrapped(F.concat("p_name", F.lit(" "), "p_type"), 18), "\n").alias("wrapped"))


@query("""WITH {ch}, p AS (SELECT project, list(idx ORDER BY idx) AS ids FROM ch WHERE status = 'error' GROUP BY project)
  SELECT project, array_to_string(list_slice(ids, 1, 4), ', ') || CASE WHEN len(ids) > 4 THEN ', … +' || (len(ids) - 4) ELSE '' END AS shown FROM p""")
def top_preview(spark, sf):
    found = ch.first_missing(chapters(spark, sf), F.col("status") == "error", 4).where("skipped > 0")
    more = F.col("skipped") - 4
    return found.select("project", F.concat(F.array_join(F.transform("first", lambda i: i.cast("string")), ", "), F.when(more > 0, F.concat(F.lit(", … +"), more.cast("string"))).otherwise("")).alias("shown"))


@query("""WITH f AS (SELECT user_id, event_type, max((ts, event_id)) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS k FROM f)
  SELECT user_id, event_type, k::INT AS place FROM r WHERE k <= 3""")
def recent_first(spark, sf):
    """Most recently used: the latest of each, newest first, at most three."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("seen"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seen")))).where("place <= 3").select("user_id", "event_type", "place")


@query("""WITH {ch} SELECT project, count(DISTINCT idx) FILTER (content <> '') AS regenerable, count(*) FILTER (content = '') AS dropped FROM ch WHERE status IN ('error', 'pending') GROUP BY project""")
def regenerable_selection(spark, sf):
    picked = chapters(spark, sf).where(F.col("status").isin("error", "pending"))
    return picked.groupBy("project").agg(F.count_distinct(F.when(F.col("content") != "", F.col("idx"))).alias("regenerable"), F.count_if(F.col("content") == "").alias("dropped"))


@query("""WITH {ch}, p AS (SELECT project, idx // 100 AS part, count(*) FILTER (audio_path <> '') AS voiced, count(*) AS n FROM ch GROUP BY ALL)
  SELECT project, part::INT AS part, CASE WHEN voiced = 0 THEN 'none' WHEN voiced = n THEN 'all' ELSE 'some' END AS state FROM p""")
def published_state(spark, sf):
    parts = chapters(spark, sf).groupBy("project", F.floor(F.col("idx") / 100).cast("int").alias("part")).agg(F.count_if(F.col("audio_path") != "").alias("voiced"), F.count(F.lit(1)).alias("n"))
    return parts.select("project", "part", F.when(F.col("voiced") == 0, "none").when(F.col("voiced") == F.col("n"), "all").otherwise("some").alias("state"))


@query("""WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)
  SELECT conv_id, turn, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n + 120 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1))::BIGINT AS start FROM s""")
def sample_offsets(spark, sf):
    """Sample-exact starts with a gap before all but the first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.select("conv_id", "turn", (F.sum("n").over(w) - F.col("n") + 120 * (F.row_number().over(w) - 1)).cast("long").alias("start"))


@query("""SELECT conv_id, string_agg('file ''' || replace('c/' || conv_id || '/it''s ' || turn || '.wav', '''', '''\\''''') || '''', chr(10) ORDER BY turn) || chr(10) AS list FROM conversations GROUP BY conv_id""".replace("\\\\", "\\"))
def concat_list(spark, sf):
    path = F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("/it's "), F.col("turn").cast("string"), F.lit(".wav"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", tl.quoted_path(path).alias("line")))).alias("rows"))
    return rows.select("conv_id", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("list"))


@query("""WITH s AS (SELECT conv_id, turn, role, length(coalesce(text, '')) * 61::BIGINT AS ms FROM conversations), o AS (SELECT *, ((sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) - ms) // 1000)::BIGINT AS t FROM s)
  SELECT conv_id, string_agg(CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END || ' ' || role, chr(10) ORDER BY turn) AS description FROM o GROUP BY conv_id""")
def chapter_table(spark, sf):
    """The time table of a description: each turn's start and title."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.length(F.coalesce("text", F.lit(""))).cast("long") * 61).alias("ms"))
    placed = tl.offsets(rows, ["conv_id"], ["turn"])
    line = F.concat(tl.short_time(F.col("start_ms") / 1000), F.lit(" "), "role")
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows")).select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("description"))


@query("""SELECT c_custkey, concat('#', lpad(lower(to_hex(c_custkey * 7919 % 16777216)), 6, '0')) AS colour,
  ((c_custkey * 7919 % 16777216) // 65536) * 0.299::DOUBLE + ((c_custkey * 7919 % 16777216) // 256 % 256) * 0.587::DOUBLE + (c_custkey * 7919 % 16777216 % 256) * 0.114::DOUBLE > 140 AS dark FROM customer""")
def text_palette(spark, sf):
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("c_custkey") * 7919 % 16777216)), 6, "0"))
    rows = table(spark, sf, "customer").select("c_custkey", colour.alias("colour"))
    return rows.select("c_custkey", "colour", ln.dark_text(F.col("colour")).alias("dark"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderdate::TIMESTAMP >= TIMESTAMP '1996-01-01' END AS fresh FROM orders""")
def freshness(spark, sf):
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", ln.fresh(stamp, F.lit(820454400.0)).alias("fresh"))


@query("""SELECT o_orderkey, strftime(o_orderdate::DATE, '%d/%m/%Y') AS day, strftime(o_orderdate::TIMESTAMP + INTERVAL 1 MINUTE * (o_orderkey % 1440), '%H:%M') AS hour FROM orders""")
def date_texts(spark, sf):
    at = F.expr("cast(o_orderdate AS timestamp_ntz) + make_dt_interval(0, 0, o_orderkey % 1440)")
    return table(spark, sf, "orders").select("o_orderkey", ln.date_text(F.col("o_orderdate"), True).alias("day"), ln.time_text(at, True).alias("hour"))


@query("""SELECT p_partkey, p_brand || ' 2.' || lower(p_type[1:1]) AS twin, lower(trim(p_name)) = lower(trim(p_type)) AS same FROM part""")
def file_twins(spark, sf):
    name = F.concat("p_brand", F.lit("."), F.lower(F.substring("p_type", 1, 1)))
    return table(spark, sf, "part").select("p_partkey", ln.renamed_twin(name, 2).alias("twin"), ln.same_name(F.col("p_name"), F.col("p_type")).alias("same"))
