"""Text operators as column expressions: cleaning, chunking, replacing, naming, parsing.

All but the packing of pieces are built-in functions, so they stay in the JVM. A null text counts as empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.slices import mapped

# The punctuation that cleaning keeps, the dashes, and what is mapped to plain signs.
KEPT = ".!?…,;:\"'“”‘’«»()"
DASHES = "—–‒―−-"
MAPPED = {"！": "!", "？": "?", "，": ",", "、": ",", "。": ".", "．": ".", "：": ":", "；": ";", "（": "(", "）": ")", "「": '"', "」": '"', "『": '"', "』": '"', "《": '"', "》": '"'}
# Fixed value: a sentence with its closing marks.
SENTENCE = r"[^.!?…]*[.!?…]+[\"'”’)]*\s*|[^.!?…]+$"
# Names that file systems reserve, and characters that they refuse.
RESERVED = ["con", "prn", "aux", "nul", ".lock", "desktop.ini", "_vti_", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
REFUSED = '"*:<>?/\\|'
LATIN = r"[\p{IsLatin}&&\p{L}&&[^ªºʰ-ʸˠ-ˤＡ-Ｚａ-ｚ]]"
HAN = "[㐀-䶿一-鿿豈-﫿]"


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, stripped; else the empty string."""
    return F.coalesce(*(F.nullif(stripped(F.coalesce(c, F.lit(""))), F.lit("")) for c in columns), F.lit(""))


def clean(text: Column, extra: str = "") -> Column:
    """Text for reading aloud: dashes and full-width punctuation are mapped; Latin letters, marks,
    digits, prosodic punctuation and line breaks stay; control characters go; all else becomes a space.
    Lines without a letter or digit are blanked, spaces collapse, and at most one empty line stays
    between paragraphs. ``extra``: further characters that become spaces."""
    out = F.translate(text, DASHES + "".join(MAPPED), "-" * len(DASHES) + "".join(MAPPED.values()))
    out = F.regexp_replace(out, r"[\t\x0B\f\r\x1C-\x1F\x85\p{Z}]", " ")
    out = F.regexp_replace(out, r"[\p{C}&&[^\n]]", "")
    out = F.regexp_replace(out, rf"[^\n\p{{M}}\p{{Nd}} {KEPT}\-{LATIN}]", " ")
    extra = "".join(dict.fromkeys(c for c in extra if not c.isspace()))
    if extra:
        out = F.translate(out, extra, " " * len(extra))
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\p{Nd}\n]+$", "")
    for pattern, new in ((" +", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def pack_pieces(pieces: list[str], limit: int, joiner: str) -> list[str]:
    out, held, size = [], [], 0
    for piece in pieces:
        if held and size + len(joiner) + len(piece) <= limit:
            held.append(piece)
            size += len(joiner) + len(piece)
        else:
            if held:
                out.append(joiner.join(held))
            held, size = [piece], len(piece)
    return [*out, joiner.join(held)] if held else out


def merge_pieces(pieces: list[str], least: int, limit: int) -> list[str]:
    out, held, size = [], [], 0
    for piece in pieces:
        if held and (size < least or len(piece) < least) and size + 1 + len(piece) <= limit:
            held.append(piece)
            size += 1 + len(piece)
        else:
            if held:
                out.append(" ".join(held))
            held, size = [piece], len(piece)
    return [*out, " ".join(held)] if held else out


def over_lists(work: Callable[[list], list[str]]) -> Callable[[Column], Column]:
    """An Arrow function of lists. Folds in the JVM copy what they have made at each step, so the time for one text would grow with its square."""
    return mapped(lambda x: None if x is None else work(x), "array<string>", pa.list_(pa.string()))


def packed(pieces: Column, limit: int, joiner: str) -> Column:
    """Greedy packing of strings, in order, into chunks of at most ``limit`` code points with ``joiner``
    between; a longer piece is a chunk of its own."""
    return over_lists(lambda x: pack_pieces(x, limit, joiner))(pieces)


def packed_each(lists: Column, limit: int, joiner: str) -> Column:
    """The chunks of several lists of strings, one list after the other; no chunk has pieces of two."""
    return over_lists(lambda x: [chunk for pieces in x for chunk in pack_pieces(pieces, limit, joiner)])(lists)


def paragraphs(text: Column, delimiter: str) -> Column:
    return F.filter(F.transform(F.split(text, re.escape(delimiter), -1), stripped), lambda p: p != "")


def paragraph_chunks(text: Column, limit: int, delimiter: str = "\n\n") -> Column:
    """Paragraphs as they stand, indents too, without blank ones, packed into chunks."""
    return packed(F.filter(F.split(text, re.escape(delimiter), -1), lambda p: stripped(p) != ""), limit, delimiter)


def sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), stripped), lambda s: s != "")


def sentence_chunks(text: Column, limit: int = 400, delimiter: str = "\n\n") -> Column:
    """Sentences packed paragraph by paragraph."""
    return packed_each(F.transform(paragraphs(text, delimiter), sentences), limit, " ")


def merge_short(chunks: Column, least: int, limit: int) -> Column:
    """Joins a chunk to the one before where either is shorter than ``least`` and both fit ``limit``."""
    return over_lists(lambda x: merge_pieces(x, least, limit))(chunks)


def literal_count(text: Column, search: str, ignore_case: bool = False) -> Column:
    if not search:
        return F.lit(0)
    return F.regexp_count(text, F.lit(("(?iu)" if ignore_case else "") + re.escape(search)))


def literal_replace(text: Column, search: str, new: str, ignore_case: bool = False) -> Column:
    """``new`` is taken as it stands; an empty search changes nothing."""
    if not search:
        return text
    if not ignore_case:
        return F.replace(text, F.lit(search), F.lit(new))
    return F.regexp_replace(text, "(?iu)" + re.escape(search), new.replace("\\", "\\\\").replace("$", "\\$"))


def glossary(text: Column, pairs: dict[str, str]) -> Column:
    """Replaces terms, the longest first and those of one length in the order given."""
    ordered = sorted(pairs.items(), key=lambda kv: -len(kv[0]))
    out = text
    for old, new in ordered:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


# The words for a chapter once accents are folded, the letters of its number in Han, and what stands around that.
CHAPTER_WORDS = ("chuong", "chapter")
HAN_NUMERALS = "〇零一二三四五六七八九十百千两"
HAN_ORDINAL, HAN_CHAPTER = "第", "章"
DIGITS = "0123456789"


def is_numbered(title: Column) -> Column:
    """Whether a title opens with a chapter mark: the word in Vietnamese (with its horns or without) or English and a number, or a number in Han between its two signs."""
    head = F.translate(F.lower(stripped(title)), "ươ", "uo")
    digit_after = lambda word: F.regexp_like(F.substring(stripped(F.substring(head, len(word) + 1, 40)), 1, 1), F.lit("[0-9]"))
    worded = F.lit(False)
    for word in CHAPTER_WORDS:
        worded = worded | (F.startswith(head, F.lit(word)) & digit_after(word))
    number = stripped(F.substring_index(F.substring(head, 2, 40), HAN_CHAPTER, 1))
    signed = F.startswith(head, F.lit(HAN_ORDINAL)) & F.contains(head, F.lit(HAN_CHAPTER)) & (number != "") & (F.translate(number, DIGITS + HAN_NUMERALS, "") == "")
    return worded | signed


def numbered_title(idx: Column, title: Column) -> Column:
    """``Chương n: `` before a title that has no chapter mark yet, n counted from 1."""
    return F.when(is_numbered(title), title).otherwise(F.concat(F.lit("Chương "), (idx + 1).cast("string"), F.lit(": "), title))


#: Letters that have no compatibility decomposition but a plain form.
STROKES = str.maketrans("đĐ", "dD")


def ascii_words(text: str) -> str:
    """Lower-case ASCII words joined by hyphens, from the ASCII letters and digits of a text's compatibility decomposition."""
    plain = unicodedata.normalize("NFKD", text.translate(STROKES))
    return "-".join("".join(c if c.isalnum() else " " for c in plain if c.isascii()).split()).lower()


def slug(text: Column, limit: int = 40) -> Column:
    """``ascii_words`` of a text, cut at ``limit``: accents go, full-width forms become plain, ligatures several letters, and an empty slug is ``novel``."""
    return mapped(lambda t: None if t is None else ascii_words(t)[:limit] or "novel", "string", pa.string())(text)


def safe_name(name: Column, limit: int = 100) -> Column:
    """A folder name: refused characters become spaces, trailing dots and spaces go, reserved names
    get an underscore, and an empty one is the slug."""
    out = stripped(F.regexp_replace(F.translate(name, REFUSED, " " * len(REFUSED)), r"(?U)\s+", " "))
    out = F.regexp_replace(out, "[. ]+$", "")
    out = F.when(F.lower(out).isin(RESERVED), F.concat(F.lit("_"), out)).otherwise(out)
    out = F.when(F.length(out) > limit, F.regexp_replace(F.substring(out, 1, limit), "[. ]+$", "")).otherwise(out)
    return F.when(out == "", slug(name)).otherwise(out)


#: What a unit of size stands for.
UNITS = {"b": 1, "byte": 1, "bytes": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}


def parse_size(text: Column) -> Column:
    """Bytes of a localised size such as ``8,3 KB`` or ``1.234 byte``, the first in a text; null without one."""
    pair = F.lit(r"(\d[\d.,]*)\s*([\p{L}\d]+)")
    found = F.arrays_zip(F.regexp_extract_all(text, pair, F.lit(1)).alias("n"), F.transform(F.regexp_extract_all(text, pair, F.lit(2)), F.lower).alias("u"))
    first = F.get(F.filter(found, lambda x: x["u"].isin(*UNITS)), F.lit(0))
    number = F.replace(F.replace(first["n"], F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    worth = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.floor(number * worth[first["u"]]).cast("long")


def format_size(size: Column) -> Column:
    """``812 B`` or ``4,2 GB``: one decimal with a comma."""
    pick = lambda p, u: F.concat(F.replace(F.format_string("%.1f", F.bround(size / F.lit(float(p)), 1)), F.lit("."), F.lit(",")), F.lit(f" {u}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, pick(1024, "KB")).when(size < 1024**3, pick(1024**2, "MB")).otherwise(pick(1024**3, "GB"))


def file_number(name: Column) -> Column:
    """The leading number of a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)-", 1), F.lit("")).cast("int")


def part_range(name: Column) -> Column:
    """struct(lo, hi) from ``…-0041-0060``, in ascending order; null without it."""
    a, b = (F.nullif(F.regexp_extract(name, r"-(\d+)-(\d+)$", k), F.lit("")).cast("int") for k in (1, 2))
    return F.when(a.isNotNull(), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


# Fixed value: the signs that mark an item of a list.
LIST_MARKS = ("-", "*", "•")
BLANK = " \t\n\x0b\f\r"


def clean_tag(raw: Column) -> Column:
    """Without one list mark (a sign, or a number with a dot or bracket), quotes, leading hashes and doubled spaces."""
    tag = stripped(raw)
    behind = F.ltrim(tag, F.lit(DIGITS))
    counted = (F.length(behind) < F.length(tag)) & F.substring(behind, 1, 1).isin(".", ")")
    unmarked = F.when(F.substring(tag, 1, 1).isin(*LIST_MARKS), F.substring(tag, F.lit(2), F.length(tag))).when(counted, F.substring(behind, F.lit(2), F.length(behind))).otherwise(tag)
    return stripped(F.regexp_replace(F.ltrim(F.btrim(unmarked, F.lit(BLANK + "\"'")), F.lit("#")), r"(?U)\s+", " "))


def tags(raw: Column, budget: int = 500) -> Column:
    """Tags within a budget of characters: a tag costs its length, 2 more with a space in it and 2 more after the
    first; repeats in another case are dropped, one too long by itself is skipped, and the first that
    overflows the sum stops."""
    pieces = F.transform(F.split(raw, r"[,\n]+", -1), lambda t: clean_tag(t))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(acc: Column, tag: Column) -> Column:
        cost = F.length(tag) + F.when(F.contains(tag, F.lit(" ")), 2).otherwise(0) + F.when(F.size(acc["kept"]) > 0, 2).otherwise(0)
        same = F.exists(acc["kept"], lambda k: F.lower(k) == F.lower(tag))
        return (
            F.when(acc["full"] | (tag == "") | same | (cost > budget), acc)
            .when(acc["total"] + cost > budget, F.struct(acc["kept"].alias("kept"), acc["total"].alias("total"), F.lit(True).alias("full")))
            .otherwise(F.struct(F.array_append(acc["kept"], tag).alias("kept"), (acc["total"] + cost).alias("total"), acc["full"].alias("full")))
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["kept"])


def voice_chunks(title: Column, body: Column, least: int = 30, limit: int = 400, extra: str = "", cleaned: bool = True) -> Column:
    """The chunks that a chapter is read aloud in: title and body, cleaned, cut into sentences and merged."""
    return merge_short(sentence_chunks(engine_text(title, body, cleaned, extra), limit), least, limit)


def glossary_pairs(names: Column, readings: Column) -> Column:
    """A glossary as a map, from names that have a reading."""
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("key"), readings.alias("value")), lambda z: z["value"].isNotNull() & (z["value"] != "")))


def engine_text(title: Column, body: Column, cleaned: bool = True, extra: str = "") -> Column:
    """The text of a chapter as it is read aloud, before it is cut."""
    text = F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)
    return clean(text, extra) if cleaned else text
