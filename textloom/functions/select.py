"""Reading many things from a page in one parse.

Selectors (``article > h1, #main p.lead[lang=fr]``) are compiled once into short chains of tests. While the page is parsed, every open
element keeps one number per chain: which of its beginnings end at the element or above it. An element thus
asks one step of each chain, whatever the depth of the page, and all that is picked is gathered as its text goes by.

What is wanted is data. A *pick* is a selector, and then ``@name`` for an attribute, ``| lines`` for the lines of a block or nothing for its text; a
*ladder* names for each field the picks to try until one is not blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.html import held, let_go
from textloom.functions.slices import over_slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
#: What an opening tag ends, if it is open within the nearest of the tags behind it.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH_ENDS = BLOCKS - {"body", "dd", "dt", "li", "td", "th", "tr"}
WALLS = {"td", "th", "table", "button", "object", "template"}

_SIMPLE = re.compile(r"""(?P<tag>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")
_TESTS = {"=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "^=": lambda have, want: bool(want) and have.startswith(want), "$=": lambda have, want: bool(want) and have.endswith(want), "*=": lambda have, want: bool(want) and want in have, "|=": lambda have, want: have == want or have.startswith(want + "-")}


class Simple(NamedTuple):
    """A test of one element; ``child``: the step before must be its parent, not just above it."""

    tag: str
    ident: str
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]
    child: bool

    def fits(self, tag: str, attributes: dict[str, str], classes: list[str]) -> bool:
        return (
            self.tag in ("", "*", tag) and (not self.ident or attributes.get("id") == self.ident) and all(c in classes for c in self.classes)
            and all(n in attributes and (not op or _TESTS[op](attributes[n], want)) for n, op, want in self.attributes)
        )


def chains(selector: str) -> list[tuple[Simple, ...]]:
    """The alternatives of a selector; one that cannot be read is an error."""
    out, steps, at, child = [], [], 0, False
    text = selector.strip()
    while at < len(text):
        if text[at] in ",>":
            if not steps or child:
                raise ValueError(f"not a selector: {selector!r}")
            if text[at] == ",":
                out.append(tuple(steps))
                steps = []
            else:
                child = True
            at += 1
        elif text[at].isspace():
            at += 1
        else:
            tag, ident, classes, attributes, begin = "", "", [], [], at
            while at < len(text) and (m := _SIMPLE.match(text, at)) and (at == begin or not m["tag"]):
                tag, ident = (m["tag"] or tag).lower(), m["id"] or ident
                if m["cls"]:
                    classes.append(m["cls"])
                if m["name"]:
                    attributes.append((m["name"].lower(), m["op"] or "", next((m[k] for k in "abc" if m[k] is not None), "")))
                at = m.end()
            if at == begin:
                raise ValueError(f"not a selector: {selector!r}")
            steps.append(Simple(tag, ident, tuple(classes), tuple(attributes), child))
            child = False
    if not steps or child:
        raise ValueError(f"not a selector: {selector!r}")
    return [*out, tuple(steps)]


class Pick(NamedTuple):
    """What to take of the elements that a selector finds: an attribute, lines, or the text."""

    selector: str
    attribute: str
    lines: bool

    @classmethod
    def of(cls, spec: str) -> Pick:
        spec = spec.strip()
        if m := re.fullmatch(r"(?s)(.*\S)\s*\|\s*lines", spec):
            return cls(m[1], "", True)
        if m := re.fullmatch(r"(?s)(.*?)\s*@([\w:-]+)", spec):
            return cls(m[1], m[2].lower(), False)
        return cls(spec, "", False)


class Open:
    """An open element: ``ends`` and ``above`` have for each chain the bits of its beginnings that end here, and here or further out."""

    __slots__ = ("tag", "ends", "above", "taken", "mutes")

    def __init__(self, tag: str, ends: list[int], above: list[int], mutes: bool):
        self.tag, self.ends, self.above, self.taken, self.mutes = tag, ends, above, [], mutes


class Reader(HTMLParser):
    """One parse of a page for all ``picks``; ``chrome`` selects what is left out of every text. ``found`` has the values of each pick in the order
    in which their elements end, the attributes' in the order in which they begin."""

    def __init__(self, picks: list[Pick], chrome: str = ""):
        super().__init__(convert_charrefs=True)
        self.picks, self.chains, self.owner = picks, [], []
        for k, selector in [*enumerate(p.selector for p in picks), *([(-1, chrome)] if chrome else [])]:
            for chain in chains(selector):
                self.chains.append(chain)
                self.owner.append(k)

    def read(self, page: str) -> list[list[str]]:
        self.reset()
        none = [0] * len(self.chains)
        self.stack, self.found, self.muted, self.open = [Open("", none, none, False)], [[] for _ in self.picks], 0, []
        self.feed(held(page))
        self.close()
        while len(self.stack) > 1:
            self.leave()
        return self.found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_implied(tag)
        attributes = {}
        for name, value in attrs:
            attributes.setdefault(name, let_go(value or ""))
        classes, outer, ends, above = attributes.get("class", "").split(), self.stack[-1], [], []
        hit = set()
        for k, chain in enumerate(self.chains):
            bits = 0
            for i, test in enumerate(chain):
                if (i == 0 or (outer.ends if test.child else outer.above)[k] >> (i - 1) & 1) and test.fits(tag, attributes, classes):
                    bits |= 1 << i
            ends.append(bits)
            above.append(outer.above[k] | bits)
            if bits >> (len(chain) - 1) & 1:
                hit.add(self.owner[k])
        here = Open(tag, ends, above, -1 in hit or tag in SILENT)
        if self.open and tag in (BLOCKS | {"br"}):
            self.said("\n")
        if not self.muted:
            for k in sorted(hit - {-1}):
                if name := self.picks[k].attribute:
                    if name in attributes:
                        self.found[k].append(attributes[name].strip())
                else:
                    here.taken.append((k, [], tag in SILENT))
        self.stack.append(here)
        if here.taken:
            self.open.append(here)
        self.muted += here.mutes
        if tag in VOID:
            self.leave()

    def end_implied(self, tag: str) -> None:
        if tag in PARAGRAPH_ENDS:
            self.end_within({"p"}, WALLS)
        if tag in ENDS:
            self.end_within(*ENDS[tag])

    def end_within(self, tags: set[str], walls: set[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                while len(self.stack) > depth:
                    self.leave()
                return
            if self.stack[depth].tag in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and any(x.tag == tag for x in self.stack[1:]):
            while self.leave() != tag:
                pass

    def leave(self) -> str:
        here = self.stack.pop()
        for k, parts, _ in here.taken:
            text = "".join(parts)
            if self.picks[k].lines:
                self.found[k] += [x for x in (" ".join(line.split()) for line in text.split("\n")) if x]
            else:
                self.found[k].append(" ".join(text.split()))
        if here.taken:
            self.open.pop()
        self.muted -= here.mutes
        if self.open and here.tag in BLOCKS:
            self.said("\n")
        return here.tag

    def handle_data(self, data: str) -> None:
        if self.open:
            # A line ends at a block, not where the source is broken.
            self.said(let_go(data).replace("\n", " "))

    def said(self, data: str) -> None:
        inner = self.stack[-1]
        for x in self.open:
            for _, parts, silent in x.taken:
                if not self.muted or silent and x is inner:
                    parts.append(data)


def read_fields(page: str | None, ladder: dict[str, list[Pick]], lists: dict[str, Pick], reader: Reader) -> dict:
    found = iter(reader.read(page or ""))
    out = {name: next((v for v in [v for _ in picks for v in next(found)[:1]] if v), "") for name, picks in ladder.items()}
    return out | {name: next(found) for name in lists}


def fields(ladder: dict[str, list[str]], lists: dict[str, str] | None = None, chrome: str = ""):
    """An Arrow function of pages that gives a struct: for each name in ``ladder`` the first value of the first pick whose first value is not blank,
    else the empty string, and for each name in ``lists`` all values of its pick. A null page is empty."""
    ladder = {n: [Pick.of(s) for s in specs] for n, specs in ladder.items()}
    lists = {n: Pick.of(s) for n, s in (lists or {}).items()}
    picks = [p for own in ladder.values() for p in own] + list(lists.values())
    Reader(picks, chrome)  # a selector that cannot be read is told here
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in ladder), *(T.StructField(n, T.ArrayType(T.StringType())) for n in lists)])

    made = pa.struct([*((n, pa.string()) for n in ladder), *((n, pa.list_(pa.string())) for n in lists)])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(picks, chrome)
        for part in over_slices(batches):
            found, part = pa.array([read_fields(p, ladder, lists, reader) for p in part.to_pylist()], made), None
            yield found

    return run
