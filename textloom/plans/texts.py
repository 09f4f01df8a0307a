"""Queries on texts: cleaning, chunking, naming, tags, terms and export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.plans.base import CHAPTERS_SQL, chapters
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  translate(coalesce(text, ''), '—–‒―−-', '------'), '[\t\x0B\f\r\x1C-\x1F\p{Z}]', ' ', 'g'),
  '[^\n\p{M}\p{Nd} .!?…,;:"''“”‘’«»()\-\p{Latin}]', ' ', 'g'), '(?m)^[^\p{L}\p{Nd}\n]+$', '', 'g'), ' +', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""

#: Paragraphs of documents; DuckDB folds chunks as one string with a separator.
INDENTED_SQL = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p) <> '')"
PARAGRAPHS_SQL = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p)), lambda p: p <> '')"


def fold_sql(pieces: str, limit: int, separator: str) -> str:
    """A greedy packing of a list of strings, in DuckDB."""
    last = "(CASE WHEN strpos(acc, chr(30)) = 0 THEN length(acc) ELSE strpos(reverse(acc), chr(30)) - 1 END)"
    return f"CASE WHEN len({pieces}) = 0 THEN [] ELSE string_split(list_reduce({pieces}, lambda acc, x: CASE WHEN {last} + 1 + length(x) <= {limit} THEN acc || {separator} || x ELSE acc || chr(30) || x END), chr(30)) END"


def merge_sql(chunks: str, least: int, limit: int) -> str:
    last = "(CASE WHEN strpos(acc, chr(30)) = 0 THEN length(acc) ELSE strpos(reverse(acc), chr(30)) - 1 END)"
    return f"CASE WHEN len({chunks}) = 0 THEN [] ELSE string_split(list_reduce({chunks}, lambda acc, x: CASE WHEN ({last} < {least} OR length(x) < {least}) AND {last} + 1 + length(x) <= {limit} THEN acc || ' ' || x ELSE acc || chr(30) || x END), chr(30)) END"


SENTENCES_SQL = r"""list_filter(list_transform(regexp_extract_all(p, '[^.!?…]*[.!?…]+["''”’)]*\s*|[^.!?…]+$'), lambda s: trim(s)), lambda s: s <> '')"""
DIGEST_SQL = "sha256(array_to_string({0}, chr(31)))"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("{ch}", CHAPTERS_SQL)
        return f

    return add


def digest(chunks):
    return F.sha2(F.array_join(chunks, "\x1f"), 256)


@query(f"""WITH c AS (SELECT lang, coalesce(text, '') AS text, {CLEAN_SQL} AS cleaned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL),
  p AS (SELECT lang, {PARAGRAPHS_SQL.replace("coalesce(text, '')", "cleaned")} AS ps FROM c), k AS (SELECT lang, {fold_sql('ps', 1500, 'chr(10)')} AS chunks FROM p)
  SELECT lang, count(*) AS documents, sum(len(chunks))::BIGINT AS chunks, coalesce(sum(list_sum(list_transform(chunks, lambda x: length(x)))), 0)::BIGINT AS chars FROM k GROUP BY lang""")
def flagship_chunk_stats(spark, sf):
    """Pending documents, cleaned and cut into paragraph chunks, by language."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    chunks = tx.paragraph_chunks(tx.clean(tx.text_of("text")), 1500, "\n")
    sized = docs.select("lang", chunks.alias("chunks")).select("lang", F.size("chunks").alias("n"), F.aggregate("chunks", F.lit(0), lambda a, x: a + F.length(x)).alias("c"))
    return sized.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"), F.sum("c").alias("chars"))


@query(f"SELECT doc_id, sha256({CLEAN_SQL}) AS cleaned_sha256 FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.clean(tx.text_of("text")), 256).alias("cleaned_sha256"))


@query(f"WITH k AS (SELECT doc_id, {fold_sql(INDENTED_SQL, 400, 'chr(10)')} AS chunks FROM documents) SELECT doc_id, len(chunks)::INT AS n, {DIGEST_SQL.format('chunks')} AS chunks_sha256 FROM k")
def paragraph_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.paragraph_chunks(tx.text_of("text"), 400, "\n").alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n"), digest("chunks").alias("chunks_sha256"))


@query(f"""WITH ps AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM (SELECT doc_id, {PARAGRAPHS_SQL} AS ps FROM documents)),
  k AS (SELECT doc_id, pos, {fold_sql('s', 400, "' '")} AS chunks FROM (SELECT doc_id, pos, {SENTENCES_SQL} AS s FROM ps)),
  f AS (SELECT doc_id, flatten(list(chunks ORDER BY pos)) AS chunks FROM k GROUP BY doc_id)
  SELECT doc_id, coalesce(len(chunks), 0)::INT AS n, {DIGEST_SQL.format("coalesce(chunks, [])")} AS chunks_sha256 FROM documents LEFT JOIN f USING (doc_id)""")
def sentence_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.sentence_chunks(tx.text_of("text"), 400, "\n").alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n"), digest("chunks").alias("chunks_sha256"))


@query(f"WITH k AS (SELECT doc_id, {merge_sql(PARAGRAPHS_SQL, 30, 400)} AS chunks FROM documents) SELECT doc_id, len(chunks)::INT AS n, {DIGEST_SQL.format('chunks')} AS chunks_sha256 FROM k")
def merge_short_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.merge_short(tx.paragraphs(tx.text_of("text"), "\n"), 30, 400).alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n"), digest("chunks").alias("chunks_sha256"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)the'))::INT AS matches, sha256(regexp_replace(coalesce(text, ''), '(?i)the', '<$1>', 'g')) AS replaced_sha256 FROM documents")
def replace_ignoring_case(spark, sf):
    text = tx.text_of("text")
    return table(spark, sf, "documents").select("doc_id", tx.literal_count(text, "the", True).alias("matches"), F.sha2(tx.literal_replace(text, "the", "<$1>", True), 256).alias("replaced_sha256"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿豈-﫿]'))::INT AS left_over FROM documents")
def script_leftover(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.han_count(tx.text_of("text")).alias("left_over"))


@query("""SELECT p_partkey, coalesce(nullif(left(lower(trim(regexp_replace(p_name || ' & ' || p_type, '[^a-zA-Z0-9]+', '-', 'g'), '-')), 40), ''), 'novel') AS slug FROM part""")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("""WITH {ch} SELECT project, idx, CASE WHEN regexp_matches(title, '(?i)^\\s*(?:ch[uư][oơ]ng|chapter)\\s*\\d|^\\s*第\\s*[\\d〇零一二三四五六七八九十百千两]+\\s*章') THEN title ELSE 'Chương ' || (idx + 1) || ': ' || title END AS heading FROM ch""".replace("\\\\", "\\"))
def number_prefix(spark, sf):
    return chapters(spark, sf).select("project", "idx", tx.numbered_title(F.col("idx"), F.col("title")).alias("heading"))


@query("""WITH n AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(translate(p_type || ' / ' || p_brand || '. ', '"*:<>?/\\|', '         '), '\\s+', ' ', 'g')), '[. ]+$', '') AS name FROM part)
  SELECT p_partkey, CASE WHEN length(name) > 100 THEN regexp_replace(left(name, 100), '[. ]+$', '') ELSE name END AS folder FROM n""".replace("\\\\", "\\"))
def safe_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.safe_name(F.concat("p_type", F.lit(" / "), "p_brand", F.lit(". "))).alias("folder"))


@query("""WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 1000 AS size FROM orders)
  SELECT o_orderkey, CASE WHEN size < 1048576 THEN replace(printf('%.1f', round_even(size / 1024.0::DOUBLE, 1)), '.', ',') || ' KB' WHEN size < 1073741824 THEN replace(printf('%.1f', round_even(size / 1048576.0::DOUBLE, 1)), '.', ',') || ' MB'
    ELSE replace(printf('%.1f', round_even(size / 1073741824.0::DOUBLE, 1)), '.', ',') || ' GB' END AS shown,
  CASE WHEN size < 1048576 THEN floor(round_even(size / 1024.0::DOUBLE, 1) * 1024) WHEN size < 1073741824 THEN floor(round_even(size / 1048576.0::DOUBLE, 1) * 1048576) ELSE floor(round_even(size / 1073741824.0::DOUBLE, 1) * 1073741824) END::BIGINT AS parsed FROM o""")
def size_round_trip(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.floor("o_totalprice").cast("long") * 1000).alias("size"))
    shown = rows.select("o_orderkey", tx.format_size(F.col("size")).alias("shown"))
    return shown.select("o_orderkey", "shown", tx.parse_size(F.col("shown")).alias("parsed"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1) AS key, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS plain FROM pages""".replace("\\\\", "\\"))
def url_keys(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"/(\d+)(?:[?#]|$)", 1).alias("key"), F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "").alias("plain"))


@query("""WITH b AS (SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_partkey) AS raw FROM part GROUP BY p_brand),
  w AS (SELECT p_brand, unnest(string_split(raw, ', ')) AS tag, generate_subscripts(string_split(raw, ', '), 1) AS pos FROM b),
  f AS (SELECT p_brand, tag, min(pos) AS pos FROM w GROUP BY p_brand, tag),
  c AS (SELECT *, length(tag) + CASE WHEN contains(tag, ' ') THEN 2 ELSE 0 END + CASE WHEN row_number() OVER v > 1 THEN 2 ELSE 0 END AS cost FROM f WINDOW v AS (PARTITION BY p_brand ORDER BY pos)),
  s AS (SELECT *, sum(cost) OVER (PARTITION BY p_brand ORDER BY pos) AS total FROM c)
  SELECT p_brand, coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (total <= 200), '') AS tags FROM s GROUP BY p_brand""")
def tag_budget(spark, sf):
    # Each tag counts where it first stands, so no brand's repeats are gathered.
    first = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("at"))
    raw = first.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("at", "p_type"))).alias("rows"))
    return raw.select("p_brand", F.array_join(tx.tags(F.array_join(F.transform("rows", lambda r: r["p_type"]), ", "), 200), ", ").alias("tags"))


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS ws FROM documents),
  t AS (SELECT unnest(ws) AS term, unnest(list_prepend('', ws)[1:len(ws)]) AS prev FROM d),
  h AS (SELECT term, prev, count(*) AS n FROM t GROUP BY ALL),
  a AS (SELECT term, sum(n)::BIGINT AS n, max(n) AS top, arg_max(prev, (n, prev)) AS top_prev FROM h GROUP BY term)
  SELECT term, n, top_prev FROM a WHERE n >= 50 AND NOT (top_prev <> '' AND top > 0.5 * n)""")
def term_mining(spark, sf):
    """Recurring words whose preceding word varies: counts and preceding-word histograms in one pass."""
    words = F.filter(F.split(F.lower(tx.text_of("text")), "[^a-z]+"), lambda w: w != "")
    rows = table(spark, sf, "documents").select(words.alias("ws")).where(F.size("ws") > 0)
    pairs = rows.select(F.explode(F.arrays_zip("ws", F.slice(F.concat(F.array(F.lit("")), "ws"), F.lit(1), F.size("ws")).alias("before"))).alias("z")).select(F.col("z.ws").alias("term"), F.col("z.before").alias("prev"))
    shares = pairs.groupBy("term", "prev").agg(F.count(F.lit(1)).alias("n"))
    terms = shares.groupBy("term").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("prev", F.struct("n", "prev")).alias("top_prev"))
    return terms.where((F.col("n") >= 50) & ~((F.col("top_prev") != "") & (F.col("top") > 0.5 * F.col("n")))).select("term", "n", "top_prev")


@query("SELECT doc_id, sha256(replace(replace(replace(coalesce(text, ''), 'there', 'THERE'), 'the', 'THE'), 'in', 'IN')) AS replaced_sha256 FROM documents")
def glossary_apply(spark, sf):
    pairs = {"in": "IN", "the": "THE", "there": "THERE"}
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.glossary(tx.text_of("text"), pairs), 256).alias("replaced_sha256"))


@query("""SELECT p_brand, p_type AS best FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY contains(p_type, 'ECONOMY'), p_size DESC, p_partkey) AS k FROM part) WHERE k = 1""")
def ranked_options(spark, sf):
    order = Window.partitionBy("p_brand").orderBy(F.contains("p_type", F.lit("ECONOMY")), F.desc("p_size"), "p_partkey")
    return table(spark, sf, "part").withColumn("k", F.row_number().over(order)).where("k = 1").select("p_brand", F.col("p_type").alias("best"))


@query("""SELECT user_id, event_id AS best FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS k FROM events) WHERE k = 1""")
def best_attempt(spark, sf):
    """Of several attempts the one with the least left over, the first of equals."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "ts", "event_id")).alias("best"))


@query("""SELECT conv_id, sha256('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || turn || ' ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn)) AS markdown_sha256, count(*) AS parts FROM conversations GROUP BY conv_id""")
def markdown_export(spark, sf):
    part = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n\n"), tx.text_of("text"), F.lit("\n"))
    docs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    whole = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    return docs.select("conv_id", F.sha2(whole, 256).alias("markdown_sha256"), F.size("parts").cast("long").alias("parts"))
