"""Queries on projects, their metadata, logs and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import timeline as tl
from textloom.operators import library as lib
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


@query("SELECT p_partkey, coalesce(nullif(left(lower(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-')), 40), ''), 'novel') || '-' || left(sha1('https://x/' || p_partkey), 8) AS key FROM part")
def project_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", lib.project_key(F.col("p_name"), F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string"))).alias("key"))


@query("""SELECT c_custkey::VARCHAR AS url, coalesce(s_name, c_name) AS title, CASE WHEN s_suppkey IS NULL THEN c_mktsegment ELSE 'supplier' END AS author, c_mktsegment AS tags FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def meta_refresh(spark, sf):
    url = lambda c: F.col(c).cast("string").alias("url")
    old = table(spark, sf, "customer").select(url("c_custkey"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.col("c_mktsegment").alias("tags"))
    scanned = table(spark, sf, "supplier").select(url("s_suppkey"), F.col("s_name").alias("title"), F.lit("supplier").alias("author"), F.lit("lost").alias("tags"))
    return lib.refreshed(old, scanned)


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'Nguồn: ' || url || ' — textloom' ELSE '' END AS note, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE 'O' || page_id END AS title, CASE WHEN page_id % 2 = 0 AND page_id % 3 <> 0 THEN 'td' ELSE 'od' END AS description FROM pages""")
def front_matter(spark, sf):
    k = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.concat(F.lit("O"), k.cast("string")).alias("title"), F.lit("od").alias("description"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string"))).otherwise("").alias("translated_title"), F.when(k % 3 != 0, "td").otherwise("").alias("translated_description"),
    )
    title, description = lib.front_matter(True)
    return rows.select("page_id", lib.source_note(F.col("url"), "textloom").alias("note"), title.alias("title"), description.alias("description"))


@query("""WITH {ch} SELECT project, idx, CASE WHEN audio_source = 'original' OR target_lang = '' THEN title ELSE target_lang END AS label FROM ch""")
def marker_titles(spark, sf):
    return chapters(spark, sf).select("project", "idx", lib.marker_title(F.col("title"), F.col("target_lang"), F.col("audio_source")).alias("label"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS title, o_orderkey % 50 AS number FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_custkey % 3 <> 0)
  SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY number, id) - 1)::INT AS idx, trim(coalesce(nullif(title, ''), 'Chương ' || number)) AS title, id FROM i""")
def json_contents(spark, sf):
    """Tables of contents as answers of an interface: errors, unpublished items and items without id are left out."""
    k = F.col("o_orderkey")
    item = F.struct(F.when(k % 11 != 0, k.cast("string")).alias("id"), (k % 50).cast("int").alias("number"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("title"), (k % 7 != 0).alias("published"))
    data = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    body = F.when(F.col("o_custkey") % 3 == 0, '{"error": "gone", "data": {"items": []}}').otherwise(F.to_json(F.struct(F.struct("items").alias("data"))))
    read = lib.envelope(F.col("body"), "struct<items:array<struct<id:string,number:int,title:string,published:boolean>>>")
    rows = data.select("o_custkey", body.alias("body")).select("o_custkey", F.explode(read["items"]).alias("i")).select("o_custkey", "i.*")
    return lib.published_refs(rows, "o_custkey")


@query("""WITH l AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'error' ELSE 'status' END AS field, event_type || ':' || event_id AS value, ts, event_id FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) AS k FROM l)
  SELECT user_id, max(value) FILTER (field = 'error') AS error, max(value) FILTER (field = 'status') AS status FROM k WHERE k = 1 GROUP BY user_id""")
def state_merge(spark, sf):
    field = F.when(F.col("event_type") == "click", "error").otherwise("status")
    log = table(spark, sf, "events").select("user_id", "ts", "event_id", F.create_map(field, F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))).alias("fields"))
    state = lib.merged_state(log, ["user_id"], ["ts", "event_id"], "fields")
    return state.select("user_id", F.try_element_at("state", F.lit("error")).alias("error"), F.try_element_at("state", F.lit("status")).alias("status"))


@query("""SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-02 12:00:00' THEN 'past' WHEN ts - TIMESTAMP '2024-01-02 12:00:00' < INTERVAL 15 MINUTE THEN 'too soon' END AS problem FROM events""")
def schedule_checks(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", lib.schedule_problem(ts, F.expr("TIMESTAMP_NTZ '2024-01-02 12:00:00'")).alias("problem"))


@query("SELECT o_orderkey, greatest(600000, least(86400000, floor(greatest(floor(o_totalprice) * 1000, 0) / 400000.0::DOUBLE * 1000 * 1.5::DOUBLE)))::BIGINT AS wait_ms, greatest(o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END) AS mtime FROM orders")
def transfer_windows(spark, sf):
    size = F.floor("o_totalprice").cast("long") * 1000
    wait = lib.window_ms(size, 400_000.0, 1.5, 600_000, 86_400_000)
    return table(spark, sf, "orders").select("o_orderkey", wait.alias("wait_ms"), lib.effective_mtime(F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))).alias("mtime"))


@query("""WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) * 7::BIGINT AS cs FROM conversations), o AS (SELECT *, sum(cs) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS e FROM s)
  SELECT conv_id, sha256(string_agg('Dialogue: 0,' || printf('%d:%02d:%02d.%02d', (e - cs) // 360000, (e - cs) // 6000 % 60, (e - cs) // 100 % 60, (e - cs) % 100) || ',' || printf('%d:%02d:%02d.%02d', e // 360000, e // 6000 % 60, e // 100 % 60, e % 100) || ',Chapter,,0,0,0,,' || replace('{' || text || '}', chr(10), '\\N').replace('{', '(').replace('}', ')') || chr(10), '' ORDER BY turn)) AS events_sha256 FROM o GROUP BY conv_id""".replace("\\\\", "\\"))
def subtitle_events(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.length(F.coalesce("text", F.lit(""))).cast("long") * 7).alias("ms"))
    placed = tl.offsets(rows, ["conv_id"], ["turn"])  # hundredths of a second here
    said = lib.event_escape(F.concat(F.lit("{"), "text", F.lit("}")))
    event = F.concat(F.lit("Dialogue: 0,"), tl.ass_time(F.col("start_ms") / 100), F.lit(","), tl.ass_time(F.col("end_ms") / 100), F.lit(",Chapter,,0,0,0,,"), said, F.lit("\n"))
    events = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("event")))).alias("events"))
    return events.select("conv_id", F.sha2(F.array_join(F.transform("events", lambda e: e["event"]), ""), 256).alias("events_sha256"))


@query("""SELECT conv_id, turn, turn * 8.0::DOUBLE + 100 AS start, (turn * 8.0::DOUBLE + 4) + 100 AS stop FROM conversations""")
def cue_scale_shift(spark, sf):
    cues = F.array(F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 5).alias("end"), F.col("role").alias("text")))
    moved = table(spark, sf, "conversations").select("conv_id", "turn", F.get(tl.scaled(cues, F.lit(1 / 1.25), F.lit(100.0)), F.lit(0)).alias("c"))
    return moved.select("conv_id", "turn", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("stop"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) >= 4 THEN t ELSE '' END AS snippet FROM (SELECT conv_id, turn, trim(regexp_extract(left(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^\\d+$'))[1], ''), 24), '^[^"\\\\]*')) AS t FROM conversations)""".replace("\\\\d", "\\d"))
def cue_snippets(spark, sf):
    said = F.concat(F.lit("1\n00:00:00,000 --> 00:00:01,000\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", lib.cue_snippet(said).alias("snippet"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value < 50)))::VARCHAR AS expected, len(list_filter(list_distinct(list(event_type) FILTER (value < 50)), lambda x: NOT list_contains(list_distinct(list(event_type) FILTER (value >= 50)), x)))::INT AS missing FROM events GROUP BY user_id HAVING count(*) FILTER (value < 50) > 0 AND count(*) FILTER (value >= 50) > 0""")
def set_difference(spark, sf):
    low, high = F.col("value") < 50, F.col("value") >= 50
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(low, F.col("event_type")))).alias("a"), F.collect_set(F.when(high, F.col("event_type"))).alias("b"))
    full = sets.where((F.size("a") > 0) & (F.size("b") > 0))
    return full.select("user_id", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("expected"), F.size(F.array_except("a", "b")).alias("missing"))


@query("""WITH c AS (SELECT conv_id, count(*) AS chunks, count(*) FILTER (length(coalesce(text, '')) > 150) AS gaps FROM conversations GROUP BY conv_id)
  SELECT conv_id, CASE WHEN chunks = 1 OR gaps = chunks - 1 THEN chunks END AS cues FROM c""")
def exact_or_none(spark, sf):
    """Cues are only taken from a file whose pauses are exactly one fewer than the chunks of its text."""
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.length(F.coalesce("text", F.lit(""))) > 150).alias("gaps"))
    return n.select("conv_id", F.when((F.col("chunks") == 1) | (F.col("gaps") == F.col("chunks") - 1), F.col("chunks")).alias("cues"))


@query("""WITH {ch} SELECT project, idx, CASE WHEN target_lang = '' AND content <> '' THEN content ELSE translated END = content AS same, CASE WHEN target_lang = '' AND content <> '' THEN 'translated' ELSE status END AS status FROM ch""")
def identity_fill(spark, sf):
    """Where the language is already the one wanted, the text is its own translation."""
    fill = (F.col("target_lang") == "") & (F.col("content") != "")
    filled = chapters(spark, sf).select("project", "idx", "content", F.when(fill, F.col("content")).otherwise(F.col("translated")).alias("translated"), F.when(fill, "translated").otherwise(F.col("status")).alias("status"))
    return filled.select("project", "idx", (F.col("translated") == F.col("content")).alias("same"), "status")
