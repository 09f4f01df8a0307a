"""Queries on pages and JSON documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import html as ht
from textloom.sources import sidecars
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\s+[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '<a\s+[^>]*?href="([^"]*)"[^>]*>')))) AS pos FROM pages),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM a)
  SELECT page_id, {href} AS href, trim({title}) AS title, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS idx FROM f WHERE k = 1""".replace("{href}", UNESCAPE_SQL.format("href")).replace("{title}", UNESCAPE_SQL.format("title")))
def toc_anchors(spark, sf):
    """Links in order, the first of each address, renumbered densely."""
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(ht.anchors(F.col("html"))).alias("pos", "a")).select("page_id", "pos", "a.href", "a.title")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "href").orderBy("pos"))).where("k = 1")
    return first.select("page_id", "href", "title", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("idx"))


@query(r"""SELECT page_id, trim({t}) AS title, trim({h}) AS heading, '' AS description, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""".replace("{t}", UNESCAPE_SQL.format(r"regexp_extract(html, '(?s)<title\b[^>]*>(.*?)</title>', 1)")).replace("{h}", UNESCAPE_SQL.format(r"regexp_extract(html, '(?s)<h1\b[^>]*>(.*?)</h1>', 1)")))
def page_metadata(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", ht.element(html, "title").alias("title"), ht.element(html, "h1").alias("heading"), ht.meta(html, "og:description").alias("description"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))


@query("""SELECT conv_id, turn, trim(coalesce(text, '')) AS body FROM conversations""")
def block_document(spark, sf):
    """A block document written as JSON and read back: dividers and empty blocks are dropped, runs are joined."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    runs = F.array(F.struct(F.substring(text, F.lit(1), half).alias("text")), F.struct(F.substring(text, half + 1, F.length(text)).alias("text")))
    empty = F.array(F.struct(F.lit("").alias("text")))
    blocks = F.array(F.struct(F.lit("divider").alias("type"), runs.alias("inline")), F.struct(F.lit("paragraph").alias("type"), empty.alias("inline")), F.struct(F.lit("paragraph").alias("type"), runs.alias("inline")))
    raw = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(blocks.alias("blocks"))).alias("json"))
    read = F.from_json("json", "blocks array<struct<type:string,inline:array<struct<text:string>>>>")["blocks"]
    return raw.select("conv_id", "turn", ht.block_text(read).alias("body"))


@query("SELECT page_id, CASE WHEN contains(lower(html), 'too many requests') THEN 'rate' WHEN contains(lower(html), 'daily limit') THEN 'daily' WHEN contains(lower(html), 'please log in') THEN 'locked' WHEN regexp_replace(html, '<[^>]*>|\\s', '', 'g') = '' THEN 'empty' ELSE 'open' END AS gate FROM pages".replace("\\\\", "\\"))
def page_gates(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.page_gate(F.col("html")).alias("gate"))


@query(None)
def page_paragraphs(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", ht.element(F.col("html"), "h1").alias("title"), ht.article_paragraphs(F.col("html")).alias("lines"))
    return rows.select("page_id", F.posexplode(ht.without_heading(F.col("lines"), F.col("title"))).alias("pos", "paragraph"))


@query("""WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(text, '') AS text FROM conversations)
  SELECT conv_id AS key, turn * 1.5::DOUBLE AS start, turn * 1.5::DOUBLE + round_even(n * 0.0612345::DOUBLE, 3) AS stop, text FROM s""")
def cue_round_trip(spark, sf):
    """Cues written as JSON side files and read back."""
    text = F.coalesce("text", F.lit(""))
    start = F.col("turn") * 1.5
    cues = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), start.alias("start"), (start + F.bround(F.length(text) * F.lit(0.0612345), 3)).alias("end"), text.alias("text"), F.lit(100.0).alias("seconds"))
    read = sidecars.parsed_cues(sidecars.cue_json(cues))
    return read.select("key", "start", F.round("end", 3).alias("stop"), "text")


@query("SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations")
def embedded_stream(spark, sf):
    """Records pushed by scripts in pieces, and found again in the stream by their keys."""
    record = F.to_json(F.struct(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("node"), F.lit("x").alias("other")))
    half = F.floor(F.length(record) / 2).cast("int")
    literal = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    piece = lambda s: F.concat(F.lit("<script>self.f.push([1,"), literal(s), F.lit("])</script>"))
    page = F.concat(F.lit('<html><script>var a = {"turn": 1};</script>'), piece(F.concat(F.lit("0:"), F.substring(record, F.lit(1), half))), piece(F.substring(record, half + 1, F.length(record))))
    pages = table(spark, sf, "conversations").select("conv_id", page.alias("html"))
    found = pages.select("conv_id", F.explode(ht.embedded(("turn", "role", "text"))(F.col("html"))).alias("m"))
    return found.select("conv_id", F.col("m")["turn"].cast("long").alias("turn"), F.col("m")["role"].alias("role"), F.col("m")["text"].alias("text"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+[^>]*?href="(/[^"?#:]*)"[^>]*>', 1)) AS href FROM pages)
  SELECT page_id, regexp_extract(url, '^https?://[^/]+') || href AS link, count(*) AS n FROM a GROUP BY ALL""")
def links_resolved(spark, sf):
    href = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+[^>]*?href="(/[^"?#:]*)"[^>]*>'), F.lit(1))).alias("href")
    rows = table(spark, sf, "pages").select("page_id", "url", href)
    return rows.select("page_id", ht.resolved("url", "href").alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '\\.net/') THEN 'net' WHEN regexp_matches(url, '/en/') THEN 'english' END AS adapter FROM pages""".replace("\\\\", "\\"))
def adapter_routing(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.routed(F.col("url"), [("secure", "^https://"), ("net", r"\.net/"), ("english", "/en/")]).alias("adapter"))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) >= 200) AS ls FROM documents)
  SELECT doc_id, coalesce(list_filter(ls, lambda x: length(x) = list_max(list_transform(ls, lambda y: length(y))))[1], '') AS prose FROM l""")
def longest_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ht.longest_prose(F.split(F.coalesce("text", F.lit("")), "\n")).alias("prose"))


@query("""SELECT conv_id, turn, role AS name, CASE WHEN turn % 2 = 0 THEN 'a' || conv_id ELSE role END AS author FROM conversations WHERE turn % 3 <> 2""")
def linked_books(spark, sf):
    """Linked data of pages: lists and single objects, authors as objects or names, and broken scripts beside them."""
    author = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"name":"a'), F.col("conv_id").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('"'), "role", F.lit('"')))
    kind = F.when(F.col("turn") % 3 == 2, "WebPage").otherwise("Book")
    book = F.concat(F.lit('{"@type":"'), kind, F.lit('","name":"'), "role", F.lit('","author":'), author, F.lit("}"))
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('[{"@type":"Thing"},'), book, F.lit("]"))).otherwise(book)
    page = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), body, F.lit("</script>"))
    found = table(spark, sf, "conversations").select("conv_id", "turn", ht.linked_data(page, "Book").alias("book")).where("book IS NOT NULL")
    return found.select("conv_id", "turn", F.try_variant_get("book", "$.name", "string").alias("name"), ht.author_of(F.col("book")).alias("author"))
