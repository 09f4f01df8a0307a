"""Queries on tables with versions, library folders, files that are written and read back, and logs that are followed."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lines as ln
from textloom.functions import timeline as tl
from textloom.operators import chapters as ch
from textloom.operators import library as lib
from textloom.operators import sync
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.plans.timelines import ORACLES as TIMELINES
from textloom.plans.timelines import cue_rows
from textloom.sources import library_source, sidecars
from textloom.sources.scratch import scratch_path
from textloom.sources.tables import table
from textloom.sources.versions import VersionedTable, span_key
from textloom.streaming import guarded, marks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


@query("""WITH {ch}, one AS (SELECT project, idx, status, target_lang, length(translated) AS chars FROM ch),
  two AS (SELECT o.project, o.idx, CASE WHEN l.doc_id IS NULL THEN status WHEN toxic = 1 THEN 'error' ELSE 'translated' END AS status, CASE WHEN toxic = 0 THEN 'vi' ELSE target_lang END AS target_lang,
    CASE WHEN toxic = 0 THEN 5 ELSE chars END AS chars FROM one o LEFT JOIN labels l ON o.idx = l.doc_id)
  SELECT 1 AS version, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM two WHERE project <> 'src1'""")
def versioned_edits(spark, sf):
    """The chapter table as it was filled, as it is after texts were saved and failed, and without a project: three versions, all read at the end."""
    rows = chapters(spark, sf)
    kept = VersionedTable(spark, scratch_path(spark, "versions"), span_key(rows=500))
    kept.replace(rows)
    labels = table(spark, sf, "labels").join(rows.select("project", "idx"), F.col("doc_id") == F.col("idx"))
    good = labels.where("toxic = 0").select("project", "idx", F.lit("texts").alias("translated"), F.lit("vi").alias("target_lang"))
    bad = labels.where("toxic = 1").select("project", "idx", F.lit("lost").alias("error"))
    kept.edit(lambda r: ch.mark_error(ch.save_translation(r, good), bad), labels)
    kept.edit(lambda r: r.where("project <> 'src1'"), rows.where("project = 'src1'"))
    out = [kept.read(v).select(F.lit(v).alias("version"), "project", "idx", "status", "target_lang", F.length("translated").cast("long").alias("chars")) for v in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(TIMELINES["srt_document"])
def documents_written(spark, sf):
    """Subtitle documents written as files, one for each conversation, and read back."""
    cues = cue_rows(spark, sf).select("conv_id", "turn", "k", (F.col("a") / 1000.0).alias("start"), (F.col("b") / 1000.0).alias("end"), F.col("line").alias("text"))
    docs = tl.srt_documents(cues, ["conv_id"], ["turn", "k"])
    folder = scratch_path(spark, "documents")
    sidecars.write_texts(docs.select(F.concat(F.lit("phần "), F.col("conv_id").cast("string"), F.lit("/a.srt")).alias("name"), F.col("document").alias("text")), folder).agg(F.sum("bytes")).collect()
    read = sidecars.read_texts(spark, folder).select(F.regexp_extract("name", r" (-?\d+)/", 1).cast("long").alias("conv_id"), "text")
    return read.select("conv_id", F.sha2("text", 256).alias("document_sha256"), F.regexp_count("text", F.lit(r"(?m)^[\d:,]+ --> [\d:,]+$")).alias("cues"))


@query("""WITH {ch} SELECT project, idx, status, audio_seconds FROM ch WHERE project IN ('src1', 'src3') AND idx BETWEEN 10 AND 700""")
def library_scan(spark, sf):
    """A range of chapters of two projects, read from a library folder by its own data source."""
    folder = scratch_path(spark, "library")
    library_source.write_library(chapters(spark, sf), folder)
    library_source.register(spark)
    rows = spark.read.format("library").load(folder)
    return rows.where(F.col("project").isin("src1", "src3") & F.col("idx").between(10, 700)).select("project", "idx", "status", "audio_seconds")


@query("""WITH f AS (SELECT 'f' || (l_suppkey % 40) AS folder, floor(l_quantity)::BIGINT AS size, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem), s AS (SELECT folder, min(k) AS first, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY folder)
  SELECT folder, row_number() OVER (ORDER BY first) - 1 AS place, files, bytes FROM s""")
def folder_order(spark, sf):
    """Folders in the order in which their first file stands among all."""
    items = table(spark, sf, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 40).cast("string")).alias("folder"), F.floor("l_quantity").cast("long").alias("size"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return sync.first_seen(items, "folder", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("""WITH {ch}, i AS (SELECT project, idx, length(content) AS size, idx % 7 * 1.5::DOUBLE AS mtime FROM ch),
  m AS (SELECT project, idx, CASE WHEN idx % 3 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN idx % 5 = 0 THEN 'none' ELSE '4' END AS mtime, CASE WHEN idx % 4 = 0 THEN 'sending' ELSE 'done' END AS status FROM i WHERE idx % 2 = 1 OR idx % 3 = 0)
  SELECT i.project, count(*) FILTER (s) AS files, coalesce(sum(i.size) FILTER (s), 0)::BIGINT AS bytes FROM (SELECT i.*, NOT coalesce(m.status = 'done' AND m.size = i.size AND i.mtime <= try_cast(m.mtime AS DOUBLE) + 2, false) AS s FROM i LEFT JOIN m ON i.project = m.project AND i.idx = m.idx) i GROUP BY i.project""")
def send_by_project(spark, sf):
    """What each project's manifest does not vouch for."""
    items = chapters(spark, sf).select("project", "idx", F.concat(F.lit("t/"), F.col("idx").cast("string")).alias("relpath"), F.length("content").cast("long").alias("size"), (F.col("idx") % 7 * 1.5).alias("mtime"))
    k = F.col("idx")
    manifest = items.where((k % 2 == 1) | (k % 3 == 0)).select("project", "relpath", F.when(k % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k % 5 == 0, "none").otherwise("4").alias("mtime"), F.when(k % 4 == 0, "sending").otherwise("done").alias("status"))
    return sync.to_send(items.drop("idx"), manifest)


@query("""WITH l AS (SELECT 'c' || conv_id AS file, turn AS t, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'sending' ELSE 'done' END AS status, length(coalesce(text, '')) AS size, turn >= 3 AS later FROM conversations WHERE turn IS NOT NULL),
  one AS (SELECT file, arg_max(status, t) AS status, max(t) AS t FROM l WHERE NOT later GROUP BY file), two AS (SELECT file, arg_max(status, t) AS status, arg_max(size, t) AS size, max(t) AS t FROM l GROUP BY file)
  SELECT file, two.status, two.size, coalesce(one.t = two.t AND one.status = 'sending', false) AS unconfirmed FROM two LEFT JOIN one USING (file)""")
def marks_followed(spark, sf):
    """A log of uploads followed by two runs: what the first left on its way is told when the second begins."""
    folder, sink, seen = (scratch_path(spark, n) for n in ("log", "told", "marks-checkpoint"))
    size = F.length(F.coalesce("text", F.lit("")))
    log = table(spark, sf, "conversations").where("turn IS NOT NULL").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("at"), F.when(size % 2 == 0, "sending").otherwise("done").alias("status"), size.cast("long").alias("size"))
    for part in (log.where("at < 3"), log.where("at >= 3")):
        part.write.mode("append").parquet(folder)
        marks.follow(spark, folder, sink, seen).awaitTermination()
    return marks.known_states(marks.told(spark, sink)).select("file", "status", "size", "unconfirmed")


@query("""WITH i AS (SELECT conv_id * 1000 + turn AS id, length(coalesce(text, '')) AS n FROM conversations), f AS (SELECT max(id) AS id FROM i WHERE n % 7 <> 0)
  SELECT id, CASE WHEN n % 7 = 0 THEN 'unreadable ' || n ELSE '' END AS error FROM i UNION ALL SELECT id, 'quota' FROM f""")
def fatal_stop(spark, sf):
    """Items of which some fail and one ends the run; the second run goes on where the first had to stop."""
    folder, sink, seen = (scratch_path(spark, n) for n in ("items", "settled-items", "guarded-checkpoint"))
    items = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    for k in (0, 1):
        items.where(F.col("id") % 2 == k).write.mode("append").parquet(folder)
    last = items.where("n % 7 <> 0").agg(F.max("id")).first()[0]

    def work(full: bool):
        fatal = F.lit(full) & (F.col("id") == last)
        return lambda batch: batch.select("id", "n", F.when(F.col("n") % 7 == 0, F.concat(F.lit("unreadable "), F.col("n").cast("string"))).when(fatal, "quota").otherwise("").alias("error"), fatal.alias("fatal"))

    for full in (True, False):
        run = guarded.guarded(spark, folder, "id long, n int", work(full), "id", "id", sink, seen, files_per_batch=1000)
        try:
            run.awaitTermination()
        except Exception as error:
            if "quota" not in str(error):
                raise
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{sink}/batch=*/{part}")
    return read("good", "id long").select("id", F.lit("").alias("error")).unionByName(read("errors", "id long, error string").select("id", "error"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS chunks, length(coalesce(text, '')) AS n FROM conversations),
  g AS (SELECT *, len(chunks) - 1 AS want, list_transform(range(greatest(len(chunks) - 1, 0)), lambda i: [i * 3 + n % 5 * 0.25 + 1.5, i * 3 + n % 5 * 0.25 + 2.25]) AS gaps, (len(chunks) * 3)::DOUBLE AS duration FROM t),
  c AS (SELECT conv_id, turn, duration, want, gaps, unnest(chunks) AS text, unnest(range(len(chunks))) AS i FROM g WHERE want = 0 OR want > 0 AND n % 3 <> 0)
  SELECT conv_id, turn, i, CASE WHEN i = 0 THEN 0 ELSE gaps[i][2]::DOUBLE END AS a, CASE WHEN i = want THEN duration ELSE gaps[i + 1][1]::DOUBLE END AS b, text FROM c""")
def backfilled_cues(spark, sf):
    """Cues recovered from a pause detector's logs under three settings: the first finds a pause too many, the second or third is right, and where neither is there are none."""
    text = F.coalesce("text", F.lit(""))
    chunks, n = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.length(text)
    gap = lambda i, more: F.concat(F.lit("[silencedetect] silence_start: "), (i * 3 + n % 5 * 0.25 + 1.5).cast("string"), F.lit("\n[silencedetect] silence_end: "), (i * 3 + n % 5 * 0.25 + 2.25).cast("string"), F.lit(" | silence_duration: 0.75\n"))
    log = lambda k: F.concat(F.lit("size=N/A\n"), F.array_join(F.transform(F.when(F.size(chunks) + k > 0, F.sequence(F.lit(0), F.size(chunks) + k - 1)).otherwise(F.array().cast("array<int>")), lambda i: gap(i, 0)), ""))
    right, late, wrong = log(-1), F.array(log(0), log(1), log(-1)), F.array(log(0), log(1), log(2))
    logs = F.when(n % 3 == 0, wrong).when(n % 3 == 1, F.array(log(0), right, right)).otherwise(late)
    cues = F.posexplode(ln.backfilled(chunks, logs, (F.size(chunks) * 3).cast("double"))).alias("i", "c")
    return table(spark, sf, "conversations").select("conv_id", "turn", cues).select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("c.start").alias("a"), F.col("c.end").alias("b"), "c.text")


@query("""WITH p AS (SELECT 'p' || (s_suppkey % 7) AS project, printf('novel-%04d-%04d', s_suppkey, s_suppkey + 9) AS folder FROM supplier), t AS (SELECT 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE n_name || ', audio' END AS tags FROM nation)
  SELECT project || '/' || folder || '/' || folder || '.tags.txt' AS name, tags || chr(10) AS text FROM p JOIN t USING (project) WHERE trim(tags) <> ''""")
def tags_restamped(spark, sf):
    """The side files of rendered parts, written again with their project's new tags and read back."""
    key = F.col("s_suppkey")
    parts = table(spark, sf, "supplier").select(F.concat(F.lit("p"), (key % 7).cast("string")).alias("project"), F.format_string("novel-%04d-%04d", key.cast("int"), (key + 9).cast("int")).alias("folder"))
    tags = table(spark, sf, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("project"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat("n_name", F.lit(", audio"))).alias("tags"))
    folder = scratch_path(spark, "tags")
    sidecars.write_texts(sync.restamped(parts, tags), folder).agg(F.sum("bytes")).collect()
    return sidecars.read_texts(spark, folder)


@query("""SELECT o_custkey, 'voice=' || coalesce(max(CASE WHEN k = 'voice' THEN v END), 'mai') || ';speed=' || coalesce(max(CASE WHEN k = 'speed' THEN v END), '1.0') || ';font=' || coalesce(max(CASE WHEN k = 'font' THEN v END), 'sans') AS settings
  FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'voice' WHEN 'F' THEN 'speed' ELSE 'other' END AS k, CASE WHEN max(o_orderkey) % 4 = 0 THEN NULL ELSE max(o_orderkey)::VARCHAR END AS v FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def run_settings(spark, sf):
    """The settings with which each run begins."""
    name = F.when(F.col("o_orderstatus") == "O", "voice").when(F.col("o_orderstatus") == "F", "speed").otherwise("other")
    chosen = table(spark, sf, "orders").groupBy("o_custkey", name.alias("name")).agg(F.max("o_orderkey").alias("k")).select("o_custkey", "name", F.when(F.col("k") % 4 != 0, F.col("k").cast("string")).alias("value"))
    found = sync.settings_of(chosen, {"voice": "mai", "speed": "1.0", "font": "sans"}, ["o_custkey"])
    part = lambda n: F.concat(F.lit(f"{n}="), F.col("settings")[n])
    return found.select("o_custkey", F.concat_ws(";", part("voice"), part("speed"), part("font")).alias("settings"))


@query("""SELECT 'local://' || left(sha256(p_partkey::VARCHAR), 32) AS url, trim(p_name) AS title, 'local' AS site, true AS local FROM part WHERE p_partkey % 5 <> 0""")
def local_projects(spark, sf):
    titles = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"))
    return lib.local_projects(titles, F.col("p_partkey")).withColumn("local", lib.is_local(F.col("url")))


@query("""WITH {ch}, m AS (SELECT project, count(*) AS n FROM ch GROUP BY project) SELECT project, CASE WHEN n % 3 = 0 THEN '{}' WHEN n % 3 = 1 THEN '{marked_by_hand=true, status=published}' ELSE '{status=sending, video_id=v}' END AS state FROM m WHERE n % 3 <> 0""")
def marked_by_hand(spark, sf):
    """States that a hand set or cleared, from a log."""
    found = chapters(spark, sf).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    began = found.select("project", F.lit(1).cast("long").alias("at"), F.create_map(F.lit("status"), F.lit("sending"), F.lit("video_id"), F.lit("v")).alias("fields"))
    cleared = sync.state_log("cleared", found.where("n % 3 <> 2").select("project"), F.lit(2).cast("long"))
    done = sync.state_log("published", found.where("n % 3 = 1").select("project"), F.lit(3).cast("long"))
    state = sync.state_of_log(began.unionByName(cleared).unionByName(done), ["project"])
    return state.select("project", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}")).alias("state"))
