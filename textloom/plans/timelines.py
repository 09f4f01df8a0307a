"""Queries on windows, timelines and subtitles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import timeline as tl
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


#: Turns as voiced segments: a character of text lasts 61 ms and an odd fraction.
TURNS_SQL = "t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) * 0.0612345::DOUBLE AS seconds FROM conversations)"


def turns(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"), (F.length(text) * F.lit(0.0612345)).alias("seconds"))


@query("""WITH {ch}, n AS (SELECT project, idx + 1 AS num, idx // 50 + 1 AS part FROM ch WHERE audio_path <> '' AND audio_voice = 'en')
  SELECT project, part::INT AS part, min(num)::INT AS first, max(num)::INT AS last, count(*) AS size FROM n GROUP BY project, part""")
def grid_windows(spark, sf):
    voiced = chapters(spark, sf).where("audio_path <> '' AND audio_voice = 'en'")
    return tl.grid_windows(voiced, ["project"], 50)


@query("""WITH {ch} SELECT project, min(idx + 1)::INT AS first, max(idx + 1)::INT AS last, count(*) AS size FROM ch WHERE audio_path <> '' AND audio_voice = 'en' AND idx + 1 BETWEEN 100 AND 700 GROUP BY project""")
def range_window(spark, sf):
    voiced = chapters(spark, sf).where("audio_path <> '' AND audio_voice = 'en' AND idx + 1 BETWEEN 100 AND 700")
    number = (F.col("idx") + 1).cast("int")
    return voiced.groupBy("project").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("size"))


@query("""WITH {t}, m AS (SELECT conv_id, turn, round_even(seconds * 1000, 0)::BIGINT AS ms FROM t), s AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM m)
  SELECT conv_id, turn, (e - ms)::BIGINT AS start_ms, e::BIGINT AS end_ms FROM s""".replace("{t}", TURNS_SQL))
def timeline_ms(spark, sf):
    rows = turns(spark, sf).select("conv_id", "turn", tl.millis(F.col("seconds")).alias("ms"))
    return tl.offsets(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "start_ms", "end_ms")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice::DOUBLE / 16 AS s FROM orders), m AS (SELECT o_orderkey, s, round_even(s * 1000, 0)::BIGINT AS ms, round_even(s * 100, 0)::BIGINT AS cs, floor(s)::BIGINT AS t FROM o)
  SELECT o_orderkey, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass,
  CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS short, s > 43200 AS long_part FROM m""")
def timestamps(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 16).alias("s"))
    return rows.select("o_orderkey", tl.srt_time(F.col("s")).alias("srt"), tl.ass_time(F.col("s")).alias("ass"), tl.short_time(F.col("s")).alias("short"), (F.col("s") > 12 * 3600).alias("long_part"))


CUES_SQL = TURNS_SQL + """, s AS (SELECT *, round_even(seconds * 1000, 0)::BIGINT AS ms FROM t), o AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) - ms AS off FROM s),
  l AS (SELECT conv_id, turn, off, ms, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, len(string_split(text, chr(10))) AS n FROM o WHERE text <> ''),
  c AS (SELECT conv_id, turn, k, line, off + ms * k // n AS a, off + ms * (k + 1) // n AS b FROM l)"""


def cue_rows(spark, sf):
    """The lines of each turn share its time evenly; childless turns still advance those after them."""
    rows = turns(spark, sf).withColumn("ms", tl.millis(F.col("seconds")))
    placed = tl.offsets(rows, ["conv_id"], ["turn"]).where("text <> ''")
    lines = placed.select("conv_id", "turn", "start_ms", "ms", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("conv_id", "turn", "k", "line", F.expr("start_ms + ms * k div n").alias("a"), F.expr("start_ms + ms * (k + 1) div n").alias("b"))


@query(f"WITH {CUES_SQL} SELECT conv_id, turn, k::INT AS k, line, a::BIGINT AS a, b::BIGINT AS b FROM c")
def part_cues(spark, sf):
    return cue_rows(spark, sf)


@query(f"""WITH {CUES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS i FROM c WHERE trim(line) <> ''),
  b AS (SELECT conv_id, i, i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || trim(line) || chr(10) AS block FROM f)
  SELECT conv_id, sha256(string_agg(block, chr(10) ORDER BY i)) AS document_sha256, count(*)::INT AS cues FROM b GROUP BY conv_id""")
def srt_document(spark, sf):
    cues = cue_rows(spark, sf).select("conv_id", "turn", "k", (F.col("a") / 1000.0).alias("start"), (F.col("b") / 1000.0).alias("end"), F.col("line").alias("text"))
    return tl.srt_documents(cues, ["conv_id"], ["turn", "k"]).select("conv_id", F.sha2("document", 256).alias("document_sha256"), "cues")


@query("""WITH {t}, s AS (SELECT conv_id, turn, role, round_even(length(coalesce(text, '')) * 0.0612345::DOUBLE * 1000, 0)::BIGINT AS ms FROM conversations), o AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM s)
  SELECT conv_id, sha256(';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms) || chr(10) || 'END=' || e || chr(10) || 'title=' || role || '\\=' || turn || chr(10), '' ORDER BY turn)) AS metadata_sha256 FROM o GROUP BY conv_id""".replace("{t}", TURNS_SQL).replace("\\\\", "\\"))
def chapter_metadata(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", tl.millis(F.length(F.coalesce("text", F.lit(""))) * F.lit(0.0612345)).alias("ms"))
    placed = tl.offsets(rows, ["conv_id"], ["turn"])
    title = tl.metadata_escape(F.concat("role", F.lit("="), F.col("turn").cast("string")))
    mark = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), title, F.lit("\n"))
    marks = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mark.alias("mark")))).alias("marks"))
    return marks.select("conv_id", F.sha2(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform("marks", lambda m: m["mark"]), "")), 256).alias("metadata_sha256"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
  SELECT o_orderkey, TIMESTAMP '2026-08-30 20:00:00' + INTERVAL 2 DAY * k AS at FROM n""")
def schedule(spark, sf):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf, "orders").select("o_orderkey", k.alias("k"))
    return rows.select("o_orderkey", F.expr("TIMESTAMP_NTZ '2026-08-30 20:00:00' + make_dt_interval(2 * k)").alias("at"))


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, count(*) AS polls, count(*) FILTER (event_type = a AND event_type = b) AS quiet FROM l GROUP BY user_id""")
def quiescence(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_type", F.lag("event_type", 1).over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("polls"), F.count_if((F.col("event_type") == F.col("a")) & (F.col("event_type") == F.col("b"))).alias("quiet"))


@query("""WITH g AS (SELECT conv_id, turn, 10.0 * (turn + 1) AS gap_start, 10.0 * (turn + 1) + 0.5 AS gap_end, lag(10.0 * (turn + 1) + 0.5, 1, 0.0) OVER w AS prev_end, lead(turn) OVER w IS NULL AS is_last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, prev_end::DOUBLE AS start, greatest(prev_end, CASE WHEN is_last THEN 1000.0 ELSE gap_start END)::DOUBLE AS stop FROM g""")
def gap_zip(spark, sf):
    """Chunk i lasts from the end of the gap before it to the start of the next, the last one to the end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.lit(10.0) * (F.col("turn") + 1)).alias("g"))
    start = F.lag(F.col("g") + 0.5, 1, 0.0).over(w)
    ends = rows.select("conv_id", "turn", start.alias("start"), F.when(F.lead("turn").over(w).isNull(), 1000.0).otherwise(F.col("g")).alias("gap"))
    return ends.select("conv_id", "turn", "start", F.greatest("start", "gap").alias("stop"))
