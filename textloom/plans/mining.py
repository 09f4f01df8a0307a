"""Queries that mine names and apply glossaries, and labels that need no table of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import html as ht
from textloom.functions import lines as ln
from textloom.functions import select as se
from textloom.functions import terms
from textloom.functions import text as tx
from textloom.functions import timeline as tl
from textloom.operators import names, sync
from textloom.operators.chapters import conformed
from textloom.plans.texts import CLEAN_SQL
from textloom.sources import sidecars
from textloom.sources.scratch import scratch_path
from textloom.sources.tables import stated, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# The texts that names are mined from are the documents' own with each letter as a Han letter. The tables of surnames and so on are stated here: small ones, not
# those of any language.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN = "江水火木金土山石田禾竹米衣車舟門雨雪風雲日月星天地人"
SINGLE, DOUBLE, DETERMINERS, FUNCTION, TITLES = set("米日竹"), {"舟石"}, set("水火"), set("天"), {"月月"}
FREQUENCIES = [("米江", 60), ("米山", 49), ("竹日", 10), ("山山", 300)]
HAN_SQL = f"translate(lower(coalesce(text, '')), '{LATIN}', '{HAN}')"


def han_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.translate(F.lower(tx.text_of("text")), LATIN, HAN).alias("text"))


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


#: Matches one after the other, each with the text between it and the one before.
MATCHES_SQL = rf"""
h AS (SELECT doc_id, {HAN_SQL} AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)({"|".join(sorted(DOUBLE))}|[{"".join(sorted(SINGLE))}])([一-鿿]{{1,2}})', 1) AS g, regexp_extract_all(text, '(?s)(.*?)({"|".join(sorted(DOUBLE))}|[{"".join(sorted(SINGLE))}])([一-鿿]{{1,2}})', 2) AS s,
  regexp_extract_all(text, '(?s)(.*?)({"|".join(sorted(DOUBLE))}|[{"".join(sorted(SINGLE))}])([一-鿿]{{1,2}})', 3) AS n FROM h),
f AS (SELECT doc_id, i, s[i] || left(n[i], 1) AS base, CASE WHEN length(n[i]) = 2 THEN s[i] || n[i] END AS whole, CASE WHEN g[i] <> '' THEN right(g[i], 1) WHEN i > 1 THEN right(n[i - 1], 1) ELSE '' END AS prev FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM m))
"""


@query(f"WITH {MATCHES_SQL} SELECT base, prev, count(*) AS n FROM f GROUP BY base, prev")
def name_candidates(spark, sf):
    """How often each surname with a letter stands behind each letter."""
    found = names.candidates(han_texts(spark, sf), SINGLE, DOUBLE)
    return found.groupBy("base", "prev").agg(F.sum("n").alias("n"))


@query(f"""WITH {MATCHES_SQL},
p AS (SELECT base, prev, count(*) AS n, min((doc_id, i)) AS first FROM f GROUP BY base, prev),
b AS (SELECT base, sum(n) AS total, max(n) AS top, arg_min(prev, (-n, first)) AS top_prev, coalesce(sum(n) FILTER (prev IN ({quoted(DETERMINERS)})), 0) AS determined FROM p GROUP BY base),
k AS (SELECT * FROM b WHERE total >= 5 AND NOT (regexp_matches(top_prev, '^[一-鿿]$') AND top > 0.5 * total) AND determined <= 0.6 * total),
w AS (SELECT base, arg_min(whole, (-n, first)) AS whole, max(n) AS n FROM (SELECT base, whole, count(*) AS n, min((doc_id, i)) AS first FROM f WHERE whole IS NOT NULL GROUP BY base, whole) GROUP BY base),
c AS (SELECT CASE WHEN w.n >= 0.8 * total THEN whole ELSE k.base END AS name, CASE WHEN w.n >= 0.8 * total THEN w.n ELSE total END::BIGINT AS count FROM k LEFT JOIN w USING (base)),
v AS (SELECT *, CASE WHEN left(name, 2) IN ({quoted(DOUBLE)}) THEN substr(name, 3) ELSE substr(name, 2) END AS given FROM c),
q AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {n})" for w, n in FREQUENCIES)}) t(word, freq)),
r AS (SELECT v.* FROM v LEFT JOIN q a ON a.word = name LEFT JOIN q e ON e.word = given WHERE NOT regexp_matches(given, '[{"".join(sorted(FUNCTION))}]') AND given NOT IN ({quoted(TITLES)}) AND coalesce(a.freq, 0) < 50 AND (length(given) < 2 OR coalesce(e.freq, 0) < 200)),
t AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS at_ FROM h),
x AS (SELECT name, CASE WHEN substr(text, at_ + length(name), 1) = chr(10) THEN '' ELSE substr(text, at_ + length(name), 1) END AS next FROM t JOIN r ON substr(text, at_, length(name)) = name),
y AS (SELECT name, next, count(*) AS n FROM x GROUP BY name, next), z AS (SELECT name, arg_max(next, (n, next)) AS top, max(n) / sum(n) AS share FROM y GROUP BY name)
SELECT r.name, r.count FROM r LEFT JOIN z USING (name) WHERE NOT coalesce(regexp_matches(top, '^[一-鿿]$') AND share >= 0.8, false)""")
def names_mined(spark, sf):
    """Names in the documents, their letters taken for Han letters, by every rule of the decision."""
    frequencies = stated(spark, FREQUENCIES, ["word", "freq"])
    return names.mine(han_texts(spark, sf), SINGLE, DOUBLE, DETERMINERS, FUNCTION, TITLES, frequencies)


@query(f"""WITH {MATCHES_SQL}, d AS (SELECT DISTINCT base AS name FROM f), r AS (SELECT unnest(string_split('{HAN[:20]}', '')) AS letter, unnest(list_transform(range(1, 21), lambda i: 'r' || i)) AS reading),
l AS (SELECT name, unnest(string_split(name, '')) AS letter, unnest(range(length(name))) AS i FROM d), j AS (SELECT name, string_agg(upper(left(reading, 1)) || substr(reading, 2), ' ' ORDER BY i) AS reading, bool_or(reading IS NULL) AS gap FROM l LEFT JOIN r USING (letter) GROUP BY name)
SELECT name, reading FROM j WHERE NOT gap""")
def name_readings(spark, sf):
    """The readings of all candidates whose letters are all known."""
    found = names.candidates(han_texts(spark, sf), SINGLE, DOUBLE).select(F.col("base").alias("name")).distinct()
    return names.readings(found, stated(spark, [(c, f"r{i + 1}") for i, c in enumerate(HAN[:20])], ["letter", "reading"]))


#: A glossary of a thousand terms of two or three letters, longest first.
TERMS = {("" if i % 3 else LATIN[i % 26]) + LATIN[i * 7 % 26] + LATIN[i // 26 % 26]: f"<{i}>" for i in reversed(range(1000))}
TERMS_SQL = "list_transform([{" + "}, {".join(f"'k': '{k}', 'v': '{v}'" for k, v in sorted(TERMS.items(), key=lambda kv: -len(kv[0]))) + "}], lambda x: x)"


@query(f"WITH g AS (SELECT {TERMS_SQL} AS terms) SELECT doc_id, sha256(list_reduce(list_prepend({{'k': '', 'v': lower(coalesce(text, ''))}}, terms), lambda a, t: {{'k': '', 'v': replace(a.v, t.k, t.v)}}).v) AS text_sha256 FROM documents, g")
def glossary_thousand(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(terms.glossary(TERMS)(F.lower(tx.text_of("text"))), 256).alias("text_sha256"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents), c AS (SELECT doc_id, {CLEAN_SQL.replace("coalesce(text, '')", "(coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, ''))")} AS text FROM documents)
SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN t.text ELSE lang || chr(10) || chr(10) || t.text END = p.plain AS same, sha256(c.text) AS cleaned_sha256, CASE WHEN t.text = '' THEN '' ELSE regexp_replace(reverse(regexp_replace(reverse(length(t.text)::VARCHAR), '(\\d\\d\\d)', '\\1,', 'g')), '^,', '') END AS chars
FROM t JOIN c USING (doc_id) JOIN (SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN coalesce(text, '') ELSE lang || chr(10) || chr(10) || coalesce(text, '') END AS plain FROM documents) p USING (doc_id)""".replace("\\\\", "\\"))
def previews(spark, sf):
    """The text of a document as an engine would get it, and its number of characters as a list shows it."""
    lang, text = tx.text_of("lang"), tx.text_of("text")
    plain = F.when(lang == "", text).otherwise(F.concat(lang, F.lit("\n\n"), text))
    return table(spark, sf, "documents").select("doc_id", (tx.engine_text(lang, text, False) == plain).alias("same"), F.sha2(tx.engine_text(lang, text), 256).alias("cleaned_sha256"), ln.grouped_count(text).alias("chars"))


@query(r"""WITH o AS (SELECT o_orderkey, o_orderkey % 90 + 1 AS k, (o_orderkey % 90 + 1) / 10.0::DOUBLE AS speed FROM orders),
p AS (SELECT o_orderkey, speed, CASE WHEN speed > 4 THEN 2 WHEN speed > 2 THEN 1 ELSE 0 END + CASE WHEN speed > 8 THEN 1 ELSE 0 END AS twos, CASE WHEN speed < 0.125 THEN 3 WHEN speed < 0.25 THEN 2 WHEN speed < 0.5 THEN 1 ELSE 0 END AS halves FROM o)
SELECT o_orderkey, twos + halves + 1 AS n, round(speed / 2 ** (twos - halves), 6) AS last FROM p""")
def tempo_steps(spark, sf):
    """Tempos as factors that a filter takes."""
    steps = ln.tempo_steps((F.col("o_orderkey") % 90 + 1) / 10.0)
    return table(spark, sf, "orders").select("o_orderkey", steps.alias("s")).select("o_orderkey", F.size("s").cast("long").alias("n"), F.round(F.element_at("s", -1), 6).alias("last"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'site' ELSE 'site (M ' || p_size || ')' END AS label, '/truyen/t/doc/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 2.5 END AS seconds,
  CASE WHEN p_size % 4 = 0 THEN 'x' ELSE 'd' END AS font, lower(trim(p_name)) = 'goldenrod' AS header, 'a' || chr(10) || p_name || chr(10) || chr(10) || 'z' AS lines, p_name AS said FROM part""")
def part_labels(spark, sf):
    """Labels and lookups that a part's row gives: model, address, length, font, heading, lines and words behind thoughts."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    option = F.when(size % 3 == 0, "AI - Memory").otherwise(F.concat(F.lit("AI  M "), size.cast("string"), F.lit(" - No Apikey")))
    fonts = F.create_map(F.lit("0"), F.lit("x"), F.lit(""), F.lit("d"))
    return table(spark, sf, "part").select(
        "p_partkey", ln.translator_label(option, "site").alias("label"), ln.chapter_url(F.lit("/truyen/t/"), F.col("p_partkey"), "/doc/").alias("url"), ln.duration_or(F.when(size % 2 == 0, size.cast("double")).otherwise(0.0), F.lit(2.5)).alias("seconds"),
        ln.looked_up(fonts, (size % 4).cast("string"), "").alias("font"), ln.is_header(F.col("p_name"), ["Goldenrod"]).alias("header"), ln.line_breaks(F.concat(F.lit(" a<br/>"), "p_name", F.lit("<BR><br ><br>z "))).alias("lines"),
        ln.thoughtless(F.concat(F.lit(" <think>"), key, F.lit("\n</think>\n"), "p_name")).alias("said"),
    )


@query("""SELECT doc_id, 'Make tags' || chr(10) || chr(10) || 'Tên truyện (tiếng Việt): T' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Tên gốc: o' ELSE '' END || CASE WHEN coalesce(source, '') <> '' THEN chr(10) || 'Tác giả: ' || source ELSE '' END ||
  CASE WHEN t <> '' THEN chr(10) || 'Mô tả: ' || left(t, 400) ELSE '' END || chr(10) || chr(10) || 'One line.' AS tags, 'Draw' || chr(10) || chr(10) || 'Tên truyện (tiếng Việt): T' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Tagline: x' ELSE '' END ||
  CASE WHEN t <> '' THEN chr(10) || 'Mô tả: ' || left(t, 600) ELSE '' END || chr(10) || chr(10) || 'No words.' AS image FROM (SELECT *, trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') AS t FROM documents)""")
def model_requests(spark, sf):
    """Requests for tags and for an image, each with its own lines and length of excerpt."""
    key, text = F.col("doc_id"), F.trim(F.regexp_replace(tx.text_of("text"), r"^[\t\n\r ]+|[\t\n\r ]+$", ""))
    tags = ln.tags_request("Make tags", "One line.", F.concat(F.lit(" T"), key.cast("string")), F.when(key % 2 == 0, "o").otherwise(" "), F.col("source"), text)
    image = ln.image_request("Draw", "No words.", F.lit("T"), F.lit(""), F.when(key % 3 == 0, "x"), text)
    return table(spark, sf, "documents").select("doc_id", tags.alias("tags"), image.alias("image"))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' ELSE 'A ' || page_id END AS author, CASE page_id % 3 WHEN 0 THEN trim(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '\s+', ' ', 'g')) ELSE 'Ｇ ' || page_id END AS blurb FROM pages""")
def author_links(spark, sf):
    """The author behind a link to an author's page, and the description in the first block that has one."""
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    more = F.when(k == 0, '<a href="/tac-gia">x</a>').otherwise(F.concat(F.lit('<a href="/the-loai/x">y</a><a href="/tac-gia/z"> A <b>'), key, F.lit('</b></a><section class="b prose"><p>Ｇ '), key, F.lit("</p></section>")))
    read = se.fields({"author": ["a[href^='/tac-gia/']"], "blurb": [".prose", "div.ad"]})
    found = table(spark, sf, "pages").select("page_id", read(F.concat(F.regexp_replace("html", "&[a-z]+;?", "+"), more)).alias("f"))
    return found.select("page_id", "f.author", "f.blurb")


ORACLES["author_links"] = ORACLES["author_links"].replace("regexp_extract(html,", "regexp_extract(regexp_replace(html, '&[a-z]+;?', '+', 'g'),")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'gb18030' WHEN 1 THEN 'utf-8' ELSE 'latin-unknown' END AS declared, sha256(url || ' 江') AS text_sha256 FROM pages""")
def charsets_repaired(spark, sf):
    """Bytes of pages that are what their declaration says, or else what pages of the wrong one are."""
    k, text = F.col("page_id") % 3, F.concat("url", F.lit(" 江"))
    raw = F.when(k == 1, F.encode(text, "utf-8")).otherwise(F.concat(F.encode(F.col("url"), "utf-8"), F.unhex(F.lit("20BDAD"))))
    declared = F.when(k == 0, "gb18030").when(k == 1, "utf-8").otherwise("latin-unknown")
    return table(spark, sf, "pages").select("page_id", declared.alias("declared"), F.sha2(ht.decoded(raw, declared), 256).alias("text_sha256"))


@query(r"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '&[a-z]+;?', '+', 'g'), '(?s)<p>([^<]*)</p>', 1), lambda x: trim(x)), lambda x: length(x) >= 200) AS ps FROM pages)
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Closed ' || page_id ELSE '' END AS message, CASE WHEN page_id % 2 = 0 THEN 'C' || page_id ELSE '' END AS code, coalesce(length(list_max(list_transform(ps, lambda x: {'n': length(x), 'x': x})).x) >= 200, false) AS prose FROM t""")
def notices_and_blocks(spark, sf):
    """What notice pages say, and whether a page's own block of prose is found."""
    key = F.col("page_id").cast("string")
    notice = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<p class="notice">Closed <b>'), key, F.lit("</b></p><code>C"), key, F.lit("</code>"))).otherwise("<p>no</p>")
    longest = F.regexp_extract_all(F.regexp_replace("html", "&[a-z]+;?", "+"), F.lit(r"(?s)<p>([^<]*)</p>"), F.lit(1))
    page = F.concat(F.lit("<nav>"), F.repeat(F.lit("menu "), 900), F.lit("</nav><div><section><div>"), F.concat_ws("</div><div>", F.transform(longest, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))), F.lit("</div></section></div>"))
    said = ht.limit_notice(notice)
    return table(spark, sf, "pages").select("page_id", said["message"].alias("message"), said["code"].alias("code"), F.exists(longest, lambda x: F.length(F.trim(x)) >= 200).alias("prose"), F.length(ht.tightest_block(page)).alias("n")).select("page_id", "message", "code", ((F.col("n") >= 200) & F.col("prose")).alias("prose"))


@query("""SELECT 'a/' || n_nationkey || '.txt' AS relpath, octet_length(encode(n_name || '江'))::BIGINT AS size, n_name || '江' AS title, '' AS author FROM nation WHERE n_nationkey % 4 <> 0""")
def files_listed(spark, sf):
    """Files that are listed without hidden and temporary ones, and metadata read from them leniently."""
    folder, key = scratch_path(spark, "listed"), F.col("n_nationkey")
    name = F.concat(F.when(key % 4 == 0, F.element_at(F.array(F.lit(".git/"), F.lit("a/.x"), F.lit("b.tmp"), F.lit("c-wal")), (key / 4 % 4 + 1).cast("int"))).otherwise(F.lit("a/")), F.when(key % 4 == 0, "").otherwise(F.concat(key.cast("string"), F.lit(".txt"))))
    rows = table(spark, sf, "nation").select(name.alias("name"), F.concat("n_name", F.lit("江")).alias("text"))
    rows = rows.withColumn("name", F.when(F.endswith("name", F.lit("/")), F.concat("name", F.lit("h"))).otherwise(F.col("name")))
    sidecars.write_texts(rows, folder).agg(F.sum("bytes")).collect()
    listed = sidecars.listing(spark, folder).select("relpath", "size")
    read = sidecars.read_texts(spark, folder).select(F.col("name").alias("key"), F.to_json(F.struct(F.col("text").alias("title"), F.lit(1).alias("unknown"))).alias("json"))
    meta = sidecars.parsed_meta(read).select(F.col("key").alias("relpath"), "title", "author")
    return listed.join(meta, "relpath")


@query("""SELECT doc_id AS idx, coalesce(text, '') = '' AS blank, 'pending' AS status, false AS title_custom, coalesce(lang, '') AS audio_voice FROM documents""")
def rows_conformed(spark, sf):
    """Rows of an older table get the columns and defaults that they lack."""
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("content"), F.col("lang").alias("audio_voice"), F.lit(1).alias("unknown"))
    return conformed(old).select("idx", (F.col("content") == "").alias("blank"), "status", "title_custom", "audio_voice")


TIME_SQL = "printf('%d:%02d:%02d.%02d', ({0})::BIGINT // 360000, ({0})::BIGINT // 6000 % 60, ({0})::BIGINT // 100 % 60, ({0})::BIGINT % 100)"
ESCAPE_SQL = "regexp_replace(replace(replace(replace(replace(replace({0}, '{{', '('), '}}', ')'), chr(13) || chr(10), '\\N'), chr(13), '\\N'), chr(10), '\\N'), '\\\\+$', '')"


@query(f"""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, role || ' {{' || turn || '}}' AS title, length(coalesce(text, '')) % 90 + 1 AS n FROM conversations), p AS (SELECT *, sum(n * 25) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS e FROM s),
  l AS (SELECT conv_id, 0 AS kind, 0 AS at_, 'Dialogue: 0,0:00:00.00,' || {TIME_SQL.format("sum(n * 25)")} || ',Novel,,0,0,0,,Book ' || conv_id || chr(10) AS line FROM s GROUP BY conv_id
    UNION ALL SELECT conv_id, 1, e - n * 25, 'Dialogue: 0,' || {TIME_SQL.format("e - n * 25")} || ',' || {TIME_SQL.format("e")} || ',Chapter,,0,0,0,,{{\\fad(400,400)}}' || {ESCAPE_SQL.format("title")} || chr(10) FROM p
    UNION ALL SELECT conv_id, 2, e - n * 25 + 5, 'Dialogue: 0,' || {TIME_SQL.format("e - n * 25 + 5")} || ',' || {TIME_SQL.format("e - 5")} || ',Sub,,0,0,0,,' || {ESCAPE_SQL.format("trim(text)")} || chr(10) FROM p WHERE trim(text) <> '')
  SELECT conv_id, sha256(string_agg(line, '' ORDER BY kind, at_)) AS events_sha256 FROM l GROUP BY conv_id""".replace("\\\\", "\\"))
def narrated_videos(spark, sf):
    """The whole event list of a video: its title, the chapters' and what is read."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))) % 90 + 1
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("Book "), F.col("conv_id").cast("string")).alias("novel"), F.concat("role", F.lit(" {"), F.col("turn").cast("string"), F.lit("}")).alias("title"), (n * 0.25).cast("double").alias("seconds"), text.alias("text"))
    placed = rows.withColumn("e", F.sum("seconds").over(Window.partitionBy("conv_id").orderBy("turn")))
    cues = placed.select("conv_id", (F.col("e") - F.col("seconds") + 0.05).alias("start"), (F.col("e") - 0.05).alias("end"), "text")
    return tl.video_events(rows, cues, ["conv_id"], "turn").select("conv_id", F.sha2("events", 256).alias("events_sha256"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages)
  SELECT page_id, CASE WHEN page_id % 3 < 2 THEN page_id END AS number, CASE WHEN page_id % 3 < 2 THEN o || '/book/' || page_id || '.htm' END AS info, CASE WHEN page_id % 3 < 2 THEN o || '/book/' || page_id || '/' END AS contents,
    CASE WHEN page_id % 3 = 2 THEN o || '/truyen/a-' || page_id END AS landing, 'T ' || page_id || ' - x' AS title FROM a""")
def site_addresses(spark, sf):
    """Numbers and names of books in addresses, and the pages that are made from them."""
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    origin = ln.origin_of(F.col("url"))
    url = F.concat(origin, F.when(k == 0, F.concat(F.lit("/book/"), key, F.lit(".htm"))).when(k == 1, F.concat(F.lit("/read/"), key, F.lit("/p7.html"))).otherwise(F.concat(F.lit("/truyen/a-"), key, F.lit("/doc/9"))))
    title = ln.without_genre(F.concat(F.lit("T "), key, F.lit(" - x  - Truyện Tiên - y")))
    return table(spark, sf, "pages").select("page_id", ln.book_number(url).alias("number"), ln.info_url(url).alias("info"), ln.contents_url(url).alias("contents"), ln.landing_url(url).alias("landing"), title.alias("title"))


@query("""SELECT p_brand, list_aggregate(list(p_partkey ORDER BY -p_size, p_partkey)[:2], 'string_agg', ',') AS tried FROM part GROUP BY p_brand""")
def models_tried(spark, sf):
    """The first two of the models that fit."""
    name = F.concat(F.lit("m "), F.col("p_size").cast("string"), F.lit(" Memory no apikey #"), F.col("p_partkey").cast("string"))
    lists = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", name.alias("name")))).alias("rows"))
    return lists.select("p_brand", F.array_join(F.transform(ln.ranked_models(F.transform("rows", lambda r: r["name"]), most=2), lambda n: F.substring_index(n, "#", -1)), ",").alias("tried"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events""")
def stamps(spark, sf):
    """Times as they are kept: in UTC, to the second."""
    return table(spark, sf, "events").select("event_id", ln.iso_seconds(F.col("ts")).alias("stamp"))


@query("""WITH r AS (SELECT l_suppkey, l_returnflag || l_linestatus AS label, row_number() OVER (PARTITION BY l_suppkey, l_returnflag || l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey) AS k, l_orderkey FROM lineitem) SELECT l_suppkey, label, l_orderkey FROM r WHERE k = 1""")
def first_labels(spark, sf):
    """Of rows with equal labels the first."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label"), "l_orderkey", "l_linenumber", "l_partkey")
    return sync.earliest(rows, ["l_suppkey", "label"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "label", "l_orderkey")


# Lines, logs and addresses that vary with the data, and oracles that state the rule.

PHRASES = ["Uploading {n} items, {p} %", "Đang tải lên {p}% của {n} tệp", "{n} files uploaded", "Đã tải lên {n} mục", "{p} % of {n}", "Waiting for {n} files", "Remaining: {n} items", "hoàn tất ({p} %)"]


def phrase_sql() -> str:
    return " ".join(f"WHEN {k} THEN " + " || ".join(f"'{x}'" if k2 % 2 == 0 else {"n": "n::VARCHAR", "p": "p::VARCHAR"}[x] for k2, x in enumerate(phrase.replace("}", "{").split("{")) if x) for k, phrase in enumerate(PHRASES))


@query(rf"""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS n, o_orderkey % 130 AS p, o_custkey % 8 AS k FROM orders), l AS (SELECT *, CASE k {phrase_sql()} END AS line FROM o),
  r AS (SELECT *, lower(line) AS low, try_cast(regexp_extract(line, '(\d+)\s*%', 1) AS INT) AS percent, try_cast(regexp_extract(lower(line), '(\d+)\s*(mục|tệp|tập tin|items?|files?)', 1) AS INT) AS count FROM l)
  SELECT o_orderkey, count, percent, CASE WHEN regexp_matches(low, 'đang tải lên|uploading|còn lại|remaining') THEN coalesce(percent >= 100, false)
    ELSE regexp_matches(low, 'đã tải lên|tải lên xong|tải lên hoàn tất|hoàn tất|đã xong|uploaded|upload complete|completed|complete') END AS done FROM r""")
def progress_read(spark, sf):
    """Status lines with numbers of all sizes."""
    n, p = (F.col("o_custkey") % 40).cast("string"), (F.col("o_orderkey") % 130).cast("string")
    lines = F.array(*(F.replace(F.replace(F.lit(x), F.lit("{n}"), n), F.lit("{p}"), p) for x in PHRASES))
    found = table(spark, sf, "orders").select("o_orderkey", ln.progress(F.get(lines, (F.col("o_custkey") % 8).cast("int"))).alias("r"))
    return found.select("o_orderkey", "r.count", "r.percent", "r.done")


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
  e AS (SELECT doc_id, arg_max(trim(line), i) AS said, arg_max(length(line) % 5, i) AS k FROM t WHERE length(line) % 3 = 0 GROUP BY doc_id),
  m AS (SELECT doc_id, CASE k WHEN 0 THEN trim(said || ' (code 429) Resets in ' || length(said) || 'm.') ELSE said END AS said FROM e)
  SELECT d.doc_id, CASE WHEN said IS NULL THEN '' WHEN contains(said, '(code 429)') OR contains(said, 'RESOURCE_EXHAUSTED') THEN 'hết hạn mức (quota) của agy (reset sau ' || rtrim(regexp_extract(said, 'Resets in ([\w.]+)', 1), '.') || '). Chờ reset hoặc đổi engine trong Cài đặt.'
    ELSE left(said, 300) END AS error FROM documents d LEFT JOIN m USING (doc_id)""")
def logs_read(spark, sf):
    """Logs whose messages are the lines of documents: some are errors, some of these are said twice, and some tell a used-up quota."""
    line = lambda x: F.trim(x)
    said = lambda x: F.when(F.length(x) % 5 == 0, F.trim(F.concat(line(x), F.lit(" (code 429) Resets in "), F.length(line(x)).cast("string"), F.lit("m.")))).when(F.length(x) % 5 == 1, F.concat(line(x), F.lit(": "), line(x))).otherwise(line(x))
    entry = lambda x: F.concat(F.when(F.length(x) % 3 == 0, F.lit("E0705 12:00:00.1 7 a.go:1] ")).otherwise(F.lit("I0705 12:00:00.1 7 a.go:1] ")), said(x))
    log = F.array_join(F.transform(F.split(tx.text_of("text"), "\n"), entry), "\n")
    return table(spark, sf, "documents").select("doc_id", ln.last_error(log).alias("error"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(url), '^https?://', '') AS rest, page_id % 5 AS k FROM pages),
  s AS (SELECT page_id, CASE k WHEN 0 THEN page_id || '-' || rest WHEN 1 THEN rest || '-' || page_id WHEN 2 THEN 'x-' || rest WHEN 3 THEN page_id::VARCHAR ELSE rest END AS slug FROM h)
  SELECT page_id, try_cast(CASE WHEN regexp_matches(slug, '^\d+([-/]|$)') THEN regexp_extract(slug, '^\d+') ELSE regexp_extract_all(slug, '\d+')[-1] END AS BIGINT) AS number FROM s""")
def hrefs_numbered(spark, sf):
    """Numbers of chapters in addresses of all shapes."""
    key, rest = F.col("page_id").cast("string"), F.regexp_replace(F.lower("url"), "^https?://", "")
    k = F.col("page_id") % 5
    slug = F.when(k == 0, F.concat(key, F.lit("-"), rest)).when(k == 1, F.concat(rest, F.lit("-"), key)).when(k == 2, F.concat(F.lit("x-"), rest)).when(k == 3, key).otherwise(rest)
    return table(spark, sf, "pages").select("page_id", ln.chapter_number(F.concat(F.lit("/truyen/9/chuong-"), slug)).alias("number"))
