"""Queries on synchronisation, batching and retention plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import sync
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


FILES_SQL = """i AS (SELECT 'o/' || o_orderkey AS relpath, floor(o_totalprice)::BIGINT AS size, o_custkey % 5000 * 1.0::DOUBLE AS mtime FROM orders),
  m AS (SELECT 'o/' || l_orderkey AS relpath, max(floor(o_totalprice))::BIGINT + max(l_linenumber) // 6 AS size, CASE WHEN max(l_linenumber) = 3 THEN 'text' ELSE (max(o_custkey) % 5000 - min(l_linenumber))::VARCHAR END AS mtime,
    CASE WHEN max(l_returnflag) = 'R' THEN 'sending' ELSE 'done' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""


def files(spark, sf):
    """Orders as a file listing, line items as the manifest of an earlier run."""
    orders = table(spark, sf, "orders")
    items = orders.select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("relpath"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_custkey") % 5000).cast("double").alias("mtime"))
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey")
    top = F.max("l_linenumber")
    manifest = lines.agg(
        (F.max(F.floor("o_totalprice")).cast("long") + F.floor(top / 6).cast("long")).alias("size"),
        F.when(top == 3, "text").otherwise((F.max("o_custkey") % 5000 - F.min("l_linenumber")).cast("string")).alias("mtime"),
        F.when(F.max("l_returnflag") == "R", "sending").otherwise("done").alias("status"),
    )
    return items, manifest.select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("relpath"), "size", "mtime", "status")


@query(f"""WITH {FILES_SQL} SELECT i.relpath, NOT coalesce(m.status = 'done' AND m.size = i.size AND i.mtime <= try_cast(m.mtime AS DOUBLE) + 2, false) AS send FROM i LEFT JOIN m USING (relpath)""")
def sync_plan(spark, sf):
    return sync.plan_uploads(*files(spark, sf)).select("relpath", "send")


@query(f"""WITH {FILES_SQL}, p AS (SELECT i.*, NOT coalesce(m.status = 'done' AND m.size = i.size AND i.mtime <= try_cast(m.mtime AS DOUBLE) + 2, false) AS send FROM i LEFT JOIN m USING (relpath))
  SELECT send, count(*) AS files, sum(size)::BIGINT AS bytes FROM p GROUP BY send""")
def library_rollup(spark, sf):
    return sync.plan_uploads(*files(spark, sf)).groupBy("send").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, floor(l_quantity)::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
  f AS (SELECT k, i, 0 AS batch, 1 AS files, size AS bytes FROM l WHERE i = 1
    UNION ALL SELECT f.k, l.i, CASE WHEN files >= 3 OR bytes + size > 60 THEN batch + 1 ELSE batch END, CASE WHEN files >= 3 OR bytes + size > 60 THEN 1 ELSE files + 1 END, CASE WHEN files >= 3 OR bytes + size > 60 THEN size ELSE bytes + size END FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
  SELECT k AS l_orderkey, batch, max(files) AS files, max(bytes)::BIGINT AS bytes FROM f GROUP BY k, batch""")
def batch_payload(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("size", F.floor("l_quantity").cast("long"))
    return sync.batches(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 3, 60)


PARTS_SQL = """a AS (SELECT 'p' || (p_size % 5) AS project, printf('%04d-', p_partkey % 300 + 1) || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.cues.json' ELSE '.txt' END AS name, p_size AS size FROM part),
  f AS (SELECT 'p' || (s_suppkey % 5) AS project, printf('novel-%04d-%04d', s_suppkey * 3, s_suppkey * 3 - s_suppkey % 7) AS folder, s_suppkey FROM supplier)"""


def retention_inputs(spark, sf):
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    number = F.format_string("%04d-", (F.col("p_partkey") % 300 + 1).cast("int"))
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".mp3").when(F.col("p_partkey") % 3 == 1, ".cues.json").otherwise(".txt")
    audio = part.select(F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("project"), F.concat(number, "p_brand", suffix).alias("name"), F.col("p_size").alias("size"))
    folder = F.format_string("novel-%04d-%04d", (F.col("s_suppkey") * 3).cast("int"), (F.col("s_suppkey") * 3 - F.col("s_suppkey") % 7).cast("int"))
    names = F.filter(F.array(F.when(F.col("s_suppkey") % 2 == 0, "part.mp4"), F.when(F.col("s_suppkey") % 3 == 0, "part.srt"), F.lit("part.txt")), lambda n: n.isNotNull())
    rows = supplier.select(F.concat(F.lit("p"), (F.col("s_suppkey") % 5).cast("string")).alias("project"), folder.alias("folder"), F.explode(names).alias("name"))
    return audio, rows


@query(f"""WITH {PARTS_SQL}, c AS (SELECT DISTINCT project, unnest(range(s_suppkey * 3 - s_suppkey % 7, s_suppkey * 3 + 1)) AS number, s_suppkey % 3 = 0 AS srt FROM f WHERE s_suppkey % 2 = 0), n AS (SELECT *, regexp_extract(name, '^(\\d+)-', 1)::BIGINT AS number FROM a)
  SELECT project, name, size, 'in a rendered part' AS reason FROM n WHERE name LIKE '%.mp3' AND EXISTS (SELECT 1 FROM c WHERE c.project = n.project AND c.number = n.number)
  UNION ALL SELECT project, name, size, 'in a part with subtitles' FROM n WHERE name LIKE '%.cues.json' AND EXISTS (SELECT 1 FROM c WHERE srt AND c.project = n.project AND c.number = n.number)""".replace("\\\\", "\\"))
def retention_plan(spark, sf):
    return sync.retention_plan(*retention_inputs(spark, sf)).select("project", "name", "size", "reason")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def pending_upload(spark, sf):
    """Rendered (semi) but neither published nor unresolved (anti)."""
    lines = table(spark, sf, "lineitem")
    flagged = lambda f: lines.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(flagged("A"), "o_orderkey", "left_semi").join(flagged("R"), "o_orderkey", "left_anti")


@query("""WITH e AS (SELECT o_orderkey AS name, floor(o_totalprice)::BIGINT AS size FROM orders), r AS (SELECT l_orderkey AS name, CASE WHEN max(l_linenumber) = 2 THEN NULL ELSE floor(sum(l_extendedprice))::BIGINT END AS size FROM lineitem GROUP BY l_orderkey)
  SELECT e.name, e.size FROM e LEFT JOIN r ON e.name = r.name WHERE r.name IS NULL OR NOT (r.size IS NULL OR (CASE WHEN e.size = 0 THEN r.size = 0 ELSE abs(r.size - e.size) <= greatest(e.size * 0.12::DOUBLE, 1) END))""")
def landed_check(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.floor("o_totalprice").cast("long").alias("size"))
    remote = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.when(F.max("l_linenumber") == 2, F.lit(None)).otherwise(F.floor(F.sum("l_extendedprice")).cast("long")).alias("size"))
    return sync.landed(expected, remote)


@query("""WITH e AS (SELECT o_orderkey AS name, floor(o_totalprice)::BIGINT AS size FROM orders), r AS (SELECT l_orderkey AS name, floor(sum(l_extendedprice))::BIGINT AS size FROM lineitem GROUP BY l_orderkey)
  SELECT e.name, coalesce(e.size > 0 AND r.size > 0 AND abs(r.size - e.size) <= e.size * 0.01::DOUBLE, false) AS safe FROM e LEFT JOIN r ON e.name = r.name""")
def delete_check(spark, sf):
    local = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.floor("o_totalprice").cast("long").alias("size"))
    remote = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.floor(F.sum("l_extendedprice")).cast("long").alias("r"))
    return local.join(remote, "name", "left").select("name", sync.safe_to_delete(F.col("size"), F.col("r")).alias("safe"))


@query("""SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_state(spark, sf):
    return sync.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), "event_id")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS state FROM events""")
def upload_state(spark, sf):
    raw = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", '{"status": ').otherwise(F.to_json(F.struct(F.col("event_type").alias("status"))))
    return table(spark, sf, "events").select("event_id", sync.upload_state(raw).alias("state"))
