"""Objects within a text that is not JSON as a whole, such as a stream of rows that hold pieces of it.

The text is read once from left to right. Braces open and close frames; a frame remembers the keys that it has
seen at its own level and how often the text looked for, the *needle*, has come by within it and was not yet claimed. When a frame with
such places closes and has all the keys asked for, it is decoded, and if it is an object, the places are its; else they are left to the
frame around it. So each place goes to the nearest object around it that has the keys, and no text is decoded for places that a nearer object took.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from textloom.functions.slices import mapped, over_slices

#: Strings end in their line, so that a stray quotation mark costs no more than a line.
TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}]')
COLON = re.compile(r"[ \t\r\n]*:")


class Frame:
    __slots__ = ("start", "keys", "places")

    def __init__(self, start: int):
        self.start, self.keys, self.places = start, set(), 0


def read_objects(stream: str, needle: str, required: tuple[str, ...]) -> Iterator[tuple[int, dict]]:
    """(offset, object) of the nearest objects around the places of ``needle`` that have all ``required`` keys, each once, in the order in which
    they end. An empty needle is nowhere."""
    places = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", stream)] if needle else []
    if not places:
        return
    open_, at, wanted, waiting = [], 0, set(required), 0
    for token in TOKEN.finditer(stream):
        if at >= len(places) and not waiting:
            return
        # Places before this token lie in the frame that is innermost now; one within a string is at its beginning or later.
        while at < len(places) and places[at] < (token.end() if token[0] != "{" else token.start()):
            if open_:
                open_[-1].places += 1
                waiting += 1
            at += 1
        if token[0] == "{":
            open_.append(Frame(token.start()))
        elif token[0] == "}":
            if not open_:
                continue
            frame = open_.pop()
            if not frame.places:
                continue
            if wanted <= frame.keys:
                try:
                    found = json.loads(stream[frame.start : token.end()])
                except ValueError:
                    pass
                else:
                    waiting -= frame.places
                    yield frame.start, found
                    continue
            if open_:
                open_[-1].places += frame.places
            else:
                waiting -= frame.places
        elif open_ and COLON.match(stream, token.end()):
            key = token[0][1:-1]
            open_[-1].keys.add(json.loads(token[0]) if "\\" in key else key)


def objects(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A row for each object found: the other columns of ``rows`` (stream, needle, others), its offset ``at`` and its text ``object``."""
    others = [f for f in rows.schema.fields if f.name not in ("stream", "needle")]
    schema = StructType([*others, StructField("at", LongType()), StructField("object", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in over_slices(batches, "stream"):
            for k, (stream, needle) in enumerate(zip(batch.column("stream").to_pylist(), batch.column("needle").to_pylist(), strict=True)):
                found = [(at, json.dumps(x, ensure_ascii=False)) for at, x in read_objects(stream or "", needle or "", required)]
                if found:
                    row = pa.array([k] * len(found))
                    arrays = [*(batch.column(f.name).take(row) for f in others), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found])]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            batch = None

    return rows.select(*(f.name for f in others), "stream", "needle").mapInArrow(run, schema)


def entries(objects: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, number, title, locked) of chapter objects (key, order, v), v a variant: those with a whole number and a lock flag, of equal ids
    (numbers where there is none) the first."""
    from pyspark.sql import Window

    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    has = lambda path: get(path, "variant").isNotNull()
    ident = F.coalesce(F.concat(F.lit("i"), F.nullif(get("id", "string"), F.lit(""))), F.concat(F.lit("n"), F.col("number").cast("string")))
    kept = objects.withColumn("number", get("chapterNumber", "long")).where(F.col("number").isNotNull() & (has("isLocked") | has("isFree")))
    first = kept.withColumn("k", F.row_number().over(Window.partitionBy(key, ident).orderBy(*order))).where("k = 1")
    return first.select(key, *order, "number", F.coalesce(get("title", "string"), F.lit("")).alias("title"), F.coalesce(get("isLocked", "boolean"), F.lit(False)).alias("locked"), F.coalesce(get("isPreview", "boolean"), F.lit(False)).alias("preview"))


def story_chapters(pages: DataFrame, key: str, origin: str = "") -> DataFrame:
    """(key, idx, number, title, url, locked) of the chapters in the streams of ``pages`` (key, slug, stream), in reading order.

    They come from the first object that names the page's own story and has a list of chapters; only where there is none, from every chapter object
    in the stream. A title that is missing says the chapter's number."""
    from pyspark.sql import Window

    quoted = F.regexp_extract(F.to_json(F.struct(F.col("slug").alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    named = objects(pages.select(key, "slug", "stream", F.concat(F.lit('"storySlug":'), quoted).alias("needle")), ("storySlug", "chapters"))
    v = F.try_parse_json("object")
    own = named.where(F.try_variant_get(v, "$.storySlug", "string") == F.col("slug")).withColumn("list", F.try_variant_get(v, "$.chapters", "array<variant>")).where("list IS NOT NULL")
    own = own.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where("k = 1")
    listed = own.select(key, F.posexplode("list").alias("at", "v")).withColumn("at", F.col("at").cast("long"))
    without = pages.join(own.select(F.col(key).alias("_own")), F.col(key) == F.col("_own"), "left_anti")
    every = objects(without.select(key, "stream", F.lit('"chapterNumber"').alias("needle")), ("chapterNumber",)).select(key, "at", F.try_parse_json("object").alias("v"))
    found = entries(listed.unionByName(every), key, ["at"]).join(pages.select(F.col(key).alias("_k"), "slug"), F.col(key) == F.col("_k"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chương "), F.col("number").cast("string")))
    url = F.concat(F.lit(f"{origin}/truyen/"), "slug", F.lit("/doc/"), F.col("number").cast("string"))
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("number", "at")) - 1).alias("idx"), "number", title.alias("title"), url.alias("url"), "locked")


#: A text shorter than this is a label, not a chapter.
LEAST_PROSE = 200


def longest_value(text: str, least: int = LEAST_PROSE) -> str:
    """The longest string value in a text with JSON in it that is no address, the first of equals; empty where none has ``least`` characters. Keys are no values."""
    best = ""
    for token in TOKEN.finditer(text):
        # An escaped string is no longer than its literal.
        if token[0][0] == '"' and len(token[0]) - 2 > max(len(best), least - 1) and not COLON.match(text, token.end()):
            try:
                value = json.loads(token[0])
            except ValueError:
                continue
            if len(value) > max(len(best), least - 1) and not value.startswith("http"):
                best = value
    return best


def longest_values(texts: Column) -> Column:
    return mapped(lambda t: longest_value(t or ""), "string", pa.string())(texts)


#: Where a chapter's text stands in markup, if its page says so.
WRAPPERS = ["article | lines", ".prose | lines", "[class*=whitespace-pre-wrap] | lines"]


def page_parts(html: Column) -> Column:
    """struct(block, said, w0, ...): all that a chapter's page may hold its text in, by one function, so that a page goes to one worker: its tightest long block, the longest
    value of its stream, and its wrappers' lines."""
    from textloom.functions.html import read_stream, read_tightest
    from textloom.functions.select import Pick, Reader

    picks = [Pick.of(w) for w in WRAPPERS]
    lists = [f"w{k}" for k in range(len(WRAPPERS))]
    schema = StructType([StructField("block", StringType()), StructField("said", StringType()), *(StructField(n, ArrayType(StringType())) for n in lists)])
    made = pa.struct([("block", pa.string()), ("said", pa.string()), *((n, pa.list_(pa.string())) for n in lists)])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(picks)
        read = lambda page: {"block": read_tightest(page), "said": longest_value(read_stream(page)), **dict(zip(lists, reader.read(page or ""), strict=True))}
        for part in over_slices(batches):
            found, part = pa.array(map(read, part.to_pylist()), made), None
            yield found

    return run(html)


def story_texts(pages: DataFrame, key: str) -> DataFrame:
    """(key, label, lines) of chapters' pages (key, html, number, title), each with its own entry in the stream that the page pushes.

    The entry's gate comes first: ``preview`` or ``locked`` pages give no text. Then the text is looked for in the markup's wrappers, in its tightest long block, in the entry and in the
    whole stream, in this order, and a first line that is the title goes: ``open``. Without any, a page with an entry is ``empty`` and one without ``missing``."""
    from textloom.functions import html as ht

    # Of the page itself only its mark goes on, not its markup.
    mark = F.when(F.contains("html", F.lit(ht.PREVIEW)), ht.PREVIEW).otherwise("")
    known = pages.select(key, mark.alias("mark"), "title", page_parts(F.col("html")).alias("found"))
    seen = objects(pages.select(key, F.col("number").alias("wanted"), ht.pushed_stream(F.col("html")).alias("stream"), F.lit('"chapterNumber"').alias("needle")), ("chapterNumber",)).withColumn("v", F.try_parse_json("object"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    own = seen.where((get("chapterNumber", "long") == F.col("wanted")) & (get("isLocked", "variant").isNotNull() | get("isFree", "variant").isNotNull()))
    first = own.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("at", F.coalesce(get("isPreview", "boolean"), F.lit(False)).alias("preview"), F.coalesce(get("isLocked", "boolean"), F.lit(False)).alias("locked"), "object")).alias("e"))
    both = known.join(first, F.col(key) == F.col("_k"), "left")
    gate = ht.entry_gate(F.col("mark"), F.col("e.preview"), F.col("e.locked"))
    wrapped = F.coalesce(*(F.when(F.length(F.array_join(F.col(f"found.w{k}"), "\n")) >= LEAST_PROSE, F.col(f"found.w{k}")) for k in range(len(WRAPPERS))))
    entry = longest_values(F.col("e.object"))
    other = F.coalesce(*(F.when(x != "", ht.paragraphs_of(x)) for x in (F.col("found.block"), entry, F.col("found.said"))))
    lines = ht.without_heading(F.coalesce(wrapped, other, F.array().cast("array<string>")), F.trim("title"))
    label = F.when(gate != "open", gate).when(F.size(lines) > 0, "open").when(F.col("e").isNull(), "missing").otherwise("empty")
    return both.select(key, label.alias("label"), F.when(label == "open", lines).alias("lines"))
