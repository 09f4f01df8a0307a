"""Queries that read pages: many fields in one parse, objects within streams, gates, tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html as ht
from textloom.functions import objects as ob
from textloom.functions import select as se
from textloom.plans.extracting import UNESCAPE_SQL
from textloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: The ladder by which a page's title is found, and what else is read from it.
LADDER = {"title": ["meta[property='og:title'] @content", "article h1", "title"], "lang": ["html @lang"], "charset": ["meta[charset] @charset"], "advert": ["div.ad"]}
LISTS = {"links": "nav > ul > li > a[href^='/'] @href", "items": "nav li"}

#: The pages, of which a third have an OpenGraph title, a third no heading, and the rest both as they are.
VARIED_SQL = r"""
v AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(html, '<meta charset', '<meta content="Shared ' || page_id || ' &amp; more" property="og:title"><meta charset')
  WHEN 1 THEN regexp_replace(html, '<h1>[^<]*</h1>', '') ELSE html END AS html, html AS plain FROM pages)
"""
AMP_SQL = "regexp_replace(replace({0}, '&quot;', '\"'), '&amp;?', '&', 'g')"


def varied(spark, sf):
    html, k = F.col("html"), F.col("page_id") % 3
    shared = F.concat(F.lit('<meta content="Shared '), F.col("page_id").cast("string"), F.lit(' &amp; more" property="og:title"><meta charset'))
    page = F.when(k == 0, F.replace(html, F.lit("<meta charset"), shared)).when(k == 1, F.regexp_replace(html, "<h1>[^<]*</h1>", "")).otherwise(html)
    return table(spark, sf, "pages").select("page_id", page.alias("html"))


@query(rf"""WITH {VARIED_SQL}, t AS (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN 'Shared ' || page_id || ' & more' WHEN 1 THEN {AMP_SQL.format(r"regexp_extract(html, '<title>([^<]*)</title>', 1)")} ELSE {AMP_SQL.format(r"regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} END AS title,
    {AMP_SQL.format(r"regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS advert, regexp_extract_all(html, '<li><a href="(/[^"]*)">', 1) AS links, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS items FROM v)
  SELECT page_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, 'utf-8' AS charset, trim(regexp_replace(advert, '\s+', ' ', 'g')) AS advert,
    {AMP_SQL.format("array_to_string(links, ' ')")} AS links, {AMP_SQL.format("array_to_string(items, ' ')")} AS items FROM t""")
def page_fields(spark, sf):
    """All fields of a page in one parse, the title by a ladder."""
    found = varied(spark, sf).select("page_id", se.fields(LADDER, LISTS)(F.col("html")).alias("f"))
    return found.select("page_id", *(F.col(f"f.{c}").alias(c) for c in LADDER), *(F.array_join(f"f.{c}", " ").alias(c) for c in LISTS))


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS body FROM pages),
  l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda x: trim(regexp_replace({AMP_SQL.format("x")}, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM a)
  SELECT page_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l""")
def page_lines(spark, sf):
    """The lines of a page's article, without what stands around it."""
    found = table(spark, sf, "pages").select("page_id", se.fields({}, {"lines": "article | lines"}, chrome="script, style, nav, .ad")(F.col("html")).alias("f"))
    return found.select("page_id", F.posexplode("f.lines").alias("pos", "line")).select("page_id", F.col("pos").cast("long").alias("pos"), "line")


#: A page for each turn: its number says which gate it has, if any, and whether it holds a text.
GATE_PARTS = [("", ""), ('<div data-preview-gate="1"></div>', "preview"), ('<script>x={"isPreview":true}</script>', "preview"), ('<script>x={"isLocked":true}</script>', "locked")]
EMPTY_PARTS = [("<p>GIỚI HẠN ĐỌC TRONG NGÀY", "daily"), ('<script>x={"isRateLimited":true}</script>', "rate"), ("Bạn đọc quá nhanh", "rate"), ("", "empty"), ("", "missing")]


def gate_pages(spark, sf):
    n, text = F.length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))
    body = F.regexp_replace(F.regexp_replace(text, "[<>&]", " "), "\n", "</p><p>")
    gate = F.element_at(F.array(*(F.lit(p) for p, _ in GATE_PARTS)), (n % 4 + 1).cast("int"))
    why = F.element_at(F.array(*(F.lit(p) for p, _ in EMPTY_PARTS)), (n % 5 + 1).cast("int"))
    empty = F.when(n % 5 == 4, F.lit("<main></main>")).otherwise(F.concat(F.lit("<article>"), F.lit("</article>"), why))
    full = F.concat(F.lit("<article><p>"), "role", F.lit("</p><p>"), body, F.lit("</p></article>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(gate, F.when(n % 7 < 3, empty).otherwise(full)).alias("html"))


@query(r"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM conversations)
  SELECT conv_id, turn, CASE WHEN n % 4 IN (1, 2) THEN 'preview' WHEN n % 4 = 3 THEN 'locked' WHEN n % 7 < 3 THEN CASE n % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'rate' WHEN 2 THEN 'rate' WHEN 3 THEN 'empty' ELSE 'missing' END WHEN len(lines) > 0 THEN 'open' ELSE 'empty' END AS label,
    CASE WHEN n % 4 = 0 AND n % 7 >= 3 AND len(lines) > 0 THEN array_to_string(lines, chr(10)) END AS body FROM t""")
def chapter_gates(spark, sf):
    """Pages of chapters with and without a gate: the gate is told before any text is taken."""
    found = gate_pages(spark, sf).select("conv_id", "turn", ht.chapter_page(F.col("html"), F.col("role")).alias("page"))
    return found.select("conv_id", "turn", "page.label", F.array_join("page.lines", "\n").alias("body"))


def json_text(c):
    return F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def story_pages(spark, sf):
    """A page for each conversation whose stream lists its turns as chapters, newest first and the first of them twice, beside another story's; every third
    page has no such list but the chapters alone."""
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    entry = lambda n, title: F.concat(F.lit('{"id":"c'), turn.cast("string"), F.lit('","chapterNumber":'), n.cast("string"), F.lit(',"title":'), json_text(title), F.lit(',"isLocked":'), F.when(F.length(text) % 2 == 1, "true").otherwise("false"), F.lit("}"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(turn.alias("k"), entry(turn + 1, F.substring(text, 1, 30)).alias("e"), entry(turn + 1, F.lit("again")).alias("g"))), asc=False).alias("es"))
    listed = F.array_join(F.concat(F.transform("es", lambda x: x["e"]), F.array(F.get("es", F.lit(0))["g"])), ",")
    own = F.concat(F.lit('5:["$","div",{"storyId":1,"storySlug":"s'), F.col("conv_id").cast("string"), F.lit('","chapters":['), listed, F.lit("]}]\n"))
    loose = F.concat(F.lit("6:["), listed, F.lit("]\n"))
    other = F.lit('1:I["x"]\n2:{"storySlug":"s0x","chapters":[{"id":"q","chapterNumber":99,"isFree":true}],"latest":{"chapterNumber":7,"title":"stub"}}\n')
    stream = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('2:{"latest":{"chapterNumber":7,"title":"stub"}}\n'), loose)).otherwise(F.concat(other, own))
    half = F.floor(F.length(stream) / 2).cast("int")
    page = F.concat(F.lit('<script>self.f.push([1,"a\\x41"])</script><script>self.f.push([1,'), json_text(F.substring(stream, F.lit(1), half)), F.lit("])</script><p>y</p><script>self.f.push([1,"), json_text(F.substring(stream, half + 1, F.length(stream))), F.lit("])</script>"))
    return rows.select("conv_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("slug"), page.alias("html"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn + 1 AS number, CASE WHEN trim(substr(coalesce(text, ''), 1, 30)) = '' THEN 'Chương ' || (turn + 1) ELSE trim(substr(text, 1, 30)) END AS title,
  '/truyen/s' || conv_id || '/doc/' || (turn + 1) AS url, length(coalesce(text, '')) % 2 = 1 AS locked FROM conversations""")
def story_chapters(spark, sf):
    """The chapters of a page's own story, found in the stream that its scripts push."""
    return ob.story_chapters(story_pages(spark, sf).select("conv_id", "slug", ht.pushed_stream(F.col("html")).alias("stream")), "conv_id")


@query("""SELECT conv_id, turn + 1 AS number, CASE WHEN length(coalesce(text, '')) % 2 = 1 THEN 'locked' ELSE 'open' END AS gate FROM conversations""")
def story_gates(spark, sf):
    """The gate of each chapter by its own entry."""
    pages = story_pages(spark, sf)
    found = ob.story_chapters(pages.select("conv_id", "slug", ht.pushed_stream(F.col("html")).alias("stream")), "conv_id").join(pages.select("conv_id", "html"), "conv_id")
    return found.select("conv_id", "number", ht.entry_gate(F.col("html"), F.lit(None).cast("boolean"), F.col("locked")).alias("gate"))


#: Contents over several pages: page ``turn + 1`` of a book lists ``length(text) % 4`` chapters, of which the first is also on the page before.
CONTENTS_SQL = """
p AS (SELECT conv_id, turn + 1 AS page, length(coalesce(text, '')) % 4 AS n, role FROM conversations),
c AS (SELECT *, min(CASE WHEN n = 0 AND page > 1 THEN page END) OVER (PARTITION BY conv_id) AS stop FROM p),
k AS (SELECT * FROM c WHERE stop IS NULL OR page < stop),
l AS (SELECT conv_id, page, role, unnest(range(n)) AS i, 3 * page + unnest(range(n)) - 1 AS number FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, number ORDER BY page, i) AS r FROM l)
"""


def contents_pages_of(spark, sf):
    n, page = F.length(F.coalesce("text", F.lit(""))) % 4, F.col("turn") + 1
    link = lambda i: F.concat(F.lit('<li><a href="/x/chuong-'), (3 * page + i - 1).cast("string"), F.lit('-a">Chương '), (3 * page + i - 1).cast("string"), F.lit(" on "), page.cast("string"), F.lit("</a>"))
    links = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), link), "")).otherwise("")
    html = F.concat(F.lit('<ul><a href="/x/chuong-1">Read on</a><a href="/x">Chương x</a>'), links, F.lit("</ul>"))
    return table(spark, sf, "conversations").select("conv_id", page.alias("page"), html.alias("html"))


@query(f"WITH {CONTENTS_SQL} SELECT k.conv_id, k.page, k.n::BIGINT AS found, count(f.i) AS new, sum(count(f.i)) OVER (PARTITION BY k.conv_id ORDER BY k.page)::BIGINT AS total FROM k LEFT JOIN f ON k.conv_id = f.conv_id AND k.page = f.page AND r = 1 GROUP BY k.conv_id, k.page, k.n")
def contents_progress(spark, sf):
    """Pages of a table of contents up to the first without a chapter, with the chapters new on each."""
    return ht.contents_pages(contents_pages_of(spark, sf), "conv_id")


@query(f"WITH {CONTENTS_SQL} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY number) - 1 AS idx, number, 'Chương ' || number || ' on ' || page AS title FROM f WHERE r = 1")
def contents_read(spark, sf):
    return ht.contents(contents_pages_of(spark, sf), "conv_id")


@query(r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, doc_id % 4 AS k FROM documents),
  l AS (SELECT doc_id, k, list_prepend(CASE k WHEN 0 THEN lines[1] WHEN 1 THEN '12. ' || lines[1] WHEN 2 THEN lines[1] || ' x' ELSE ' ' || lines[1] END, lines) AS every, lines[1] AS title FROM t)
  SELECT doc_id, len(every) - CASE WHEN trim(regexp_replace(every[1], '^\s*\d+\s*[.、．]\s*', '')) = trim(regexp_replace(title, '^\s*\d+\s*[.、．]\s*', '')) THEN 1 ELSE 0 END AS n FROM l""")
def headings_dropped(spark, sf):
    """A first line that repeats the title, with a number before it or without."""
    lines, k = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("doc_id") % 4
    title = F.get(lines, F.lit(0))
    head = F.when(k == 0, title).when(k == 1, F.concat(F.lit("12. "), title)).when(k == 2, F.concat(title, F.lit(" x"))).otherwise(F.concat(F.lit(" "), title))
    return table(spark, sf, "documents").select("doc_id", F.size(ht.without_same_heading(F.array_prepend(lines, head), title)).cast("long").alias("n"))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, length(coalesce(text, '')) AS n, trim(regexp_replace(coalesce(text, ''), '[<>&"\\\\\s]+', ' ', 'g')) AS body, CASE WHEN length(coalesce(text, '')) % 5 = 0 THEN length(role) + 1 ELSE 0 END AS more FROM conversations)
  SELECT id, CASE WHEN n % 7 = 1 THEN 'locked' WHEN n % 7 = 2 THEN 'preview' WHEN length(body) + more >= 200 THEN 'open' WHEN n % 5 = 4 THEN 'missing' ELSE 'empty' END AS label, CASE WHEN n % 7 NOT IN (1, 2) AND length(body) + more >= 200 THEN body END AS body FROM t""".replace("\\\\", "\\"))
def story_texts(spark, sf):
    """The texts of chapters' pages, wherever they stand: in a wrapper, in a plain block, in the chapter's entry or in a row of the stream beside it."""
    text = F.coalesce("text", F.lit(""))
    n, body = F.length(text), F.trim(F.regexp_replace(text, r'[<>&"\\\s]+', " "))
    where = n % 5
    entry = lambda own: F.concat(F.lit('{"id":"a","chapterNumber":'), F.col("turn").cast("string"), F.lit(',"url":"http://'), F.repeat(F.lit("x"), 9000), F.lit('","isLocked":'), F.when(n % 7 == 1, "true").otherwise("false"), F.lit(',"isPreview":'), F.when(n % 7 == 2, "true").otherwise("false"), F.lit(',"text":'), json_text(own), F.lit("}"))
    stream = F.concat(F.lit('1:{"chapterNumber":-9,"isFree":true}\n2:'), F.when((where == 4) & ~(n % 7).isin(1, 2), F.lit("[]")).otherwise(entry(F.when(where == 2, body).otherwise("x"))), F.lit("\n3:"), json_text(F.when(where >= 3, body).otherwise("")))
    block = F.concat(F.lit("<p>"), "role", F.lit("</p><p>"), body, F.lit("</p>"))
    markup = F.when(where == 0, F.concat(F.lit('<div class="x prose">'), block, F.lit("</div>"))).when(where == 1, F.concat(F.lit("<nav>"), F.repeat(F.lit("menu "), 5000), F.lit("</nav><section><div><p>"), body, F.lit("</p></div></section>"))).otherwise("<p>short</p>")
    pages = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(markup, F.lit("<script>self.f.push([1,"), json_text(stream), F.lit("])</script>")).alias("html"), F.col("turn").alias("number"), F.col("role").alias("title"))
    return ob.story_texts(pages, "id").select("id", "label", F.array_join("lines", "\n").alias("body"))


# The older query of the same paragraphs, which drops the heading, gets its rule too.
PARAGRAPHS_ORACLE = ORACLES["page_lines"].replace("SELECT page_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l", "", 1) + f"""
  , h AS (SELECT l.page_id, CASE WHEN lines[1] = trim({UNESCAPE_SQL.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}) THEN lines[2:] ELSE lines END AS lines FROM l JOIN pages USING (page_id))
  SELECT page_id, unnest(lines) AS paragraph, unnest(range(len(lines))) AS pos FROM h"""
ORACLES["page_paragraphs"] = PARAGRAPHS_ORACLE
